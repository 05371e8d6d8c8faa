"""Spelling variants, Merkle manifest and SentencePiece against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_data import empty, messy, messy_rows, prose
from pyspark.sql import functions as F
from test_llm_operators import brute_components

from shoal.llm import merkle, spelling
from shoal.llm.lm_score import lm_scores
from shoal.llm.merkle import tamper_check
from shoal.llm.near_dedup import near_duplicates
from shoal.llm.pieces import BYTE, SPACE, Model, PieceDecoder, PieceEncoder, _fields, decode_pieces, encode_pieces, load_model, merge
from shoal.llm.spelling import corrupted, scan, spelling_variants, word_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


# -- spelling variants --------------------------------------------------------------------

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: best[w] if w in best and counts[best[w]] >= ratio * counts[w] else None for w in counts}

    def root(w):
        return root(form[w]) if form[w] else w
    return sorted(((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts), key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_scan_finds_words_one_edit_away():
    rng = random.Random(5)
    for t in range(400):
        letters = "ab" if t % 2 else "abé"
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 60))})
        shared = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(words, words[1:])]
        for query in [*words[:12], "".join(rng.choice(letters) for _ in range(5))]:
            assert scan(query, words, shared) == [i for i, w in enumerate(words) if one_edit(query, w)]


@pytest.mark.parametrize("limit", [2, 2000])
def test_variants_equal_all_pairs(spark, limit):
    """Small groups by a low limit, chains of forms, ties of counts, repeated letters, long words."""
    rng = random.Random(limit)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))): rng.choice([5, 6, 30, 200, 1000, 6000, 40000]) for _ in range(700)}
    counts |= {"z" * 3000: 5, "z" * 2999: 50, "z" * 1500 + "y" + "z" * 1499: 7, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125}
    got = spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), group_words=limit)
    assert rows_of(got, *COLUMNS) == plain_variants(counts)


def test_words_are_counted_and_corrupted(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    rows = messy_rows() + [(17, "Straße éÀÿ×÷ab ABCDEFé1ABCDEFé " * 3, "de", "a", 0)] * 2
    want = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run
            want[word] += len(word) >= 6
    docs = messy(spark).unionByName(spark.createDataFrame(rows[-2:], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    assert rows_of(word_counts(docs), "word", "n") == sorted(((w, n) for w, n in want.items() if n >= 5), key=repr)
    assert corrupted("abcdef", zlib.crc32(b"1:"), 1) != "abcdef" and len(corrupted("abcdef", zlib.crc32(b"1:"), 1)) == 5


def test_variants_of_nothing(spark):
    assert spelling_variants(word_counts(empty(spark))).collect() == []
    one = spark.createDataFrame([("single", 9)], "word string, n long")
    assert rows_of(spelling_variants(one), *COLUMNS) == [("single", None, "single", 9, 0, None)]


# -- Merkle manifest -----------------------------------------------------------------------

def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        first = i // 3 * 3
        out.append(("".join(level[first:i]), "".join(level[i + 1:first + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {s: levels([leaf_of(r) for r in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = siblings(trees[s], i) + siblings(top, place)
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            folded = leaf_of((*r[:4], text))
            for a, b in path:
                folded = h(a + folded + b)
            root = top[-1][0]
            out.append((r[0], leaf_of(r), trees[s][-1][0], root, h("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def checked(docs):
    got = tamper_check(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return rows_of(got, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("depth,n,sources", [(4, 400, 5), (1, 60, 12), (2, 250, 100), (4, 1, 1), (1, 28, 1)])
def test_manifest_equals_the_plain_one(spark, monkeypatch, depth, n, sources):
    """Several records on the way down, copies with equal digests, a lone source, sources ordered by bytes."""
    monkeypatch.setattr(merkle, "LEVELS", depth)
    monkeypatch.setattr(merkle, "SPAN", 3 ** depth)
    rng = random.Random(n)
    names = [None, *[rng.choice("aé\U0001f600") * (j % 3) + str(j) for j in range(sources)]] if sources > 1 else ["a"]
    rows = [(rng.choice([None, i, i, i // 2]), rng.choice(names), rng.choice([None, "en"]), rng.choice([None, i]), rng.choice([None, "", "a\nb\n", "é" * i])) for i in range(n)]
    rows += rows[:n // 3] + [rows[0]] * (n // 4)
    assert checked(spark.createDataFrame(rows, SCHEMA)) == plain_manifest(rows)


def test_manifest_of_awkward_rows(spark):
    rows = [(i, s, la, c, t) for i, t, la, s, c in messy_rows()]
    assert checked(messy(spark)) == plain_manifest(rows)
    assert checked(empty(spark)) == []


# -- SentencePiece --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def awkward_texts(n, seed=3):
    rng = random.Random(seed)
    signs = [*"abcdeth .,;\n\t\r\0(){}=<>_-'\"0123ABC", "▁", "  ", "é", "中", "한", "\U0001f916", "�", "the", "ing", "▁▁", "<s>", "<0x41>", "​", "    ", "　"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(n)]
    return texts + ["x" * 5000, " " * 3000, "▁" * 100, "a\n" * 500, " ", "▁", " a"]


def test_pieces_equal_the_library(library, monkeypatch):
    from shoal.llm import pieces
    model = Model(load_model(MODEL))
    encoder, decoder = PieceEncoder(model), PieceDecoder(model)
    for size in (pieces.CHUNK, 7):
        monkeypatch.setattr(pieces, "CHUNK", size)
        monkeypatch.setattr(pieces, "SHORT", min(size, 48))
        monkeypatch.setattr(pieces, "CACHE_RUNS", size)
        for text in awkward_texts(800):
            ids, begins, stops = encoder(text)
            assert ids.tolist() == library.encode(text)
            assert decoder(ids) == library.decode(ids.tolist())
            raw = text.encode()
            assert (begins <= stops).all() and (len(ids) == 0 or stops[-1] == len(raw)) and (begins[1:] == stops[:-1]).all()
            for k, (i, a, b) in enumerate(zip(ids.tolist(), begins.tolist(), stops.tolist())):
                piece, held = model.pieces[i], raw[a:b]
                if model.kinds[i] == BYTE:
                    assert held == bytes([int(piece[3:5], 16)])
                else:  # the first piece holds the sign that is put before the text
                    assert held.decode().replace(" ", SPACE) == (piece[1:] if k == 0 else piece)


def test_any_ids_are_decoded_like_the_library(library):
    decoder, rng = PieceDecoder(Model(load_model(MODEL))), random.Random(1)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 28705, 1, 2, 0]) for _ in range(rng.randrange(0, 12))]
        assert decoder(np.array(ids, np.int64)) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_character_maps_and_their_alignment(rule):
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    model = Model(load_model(MODEL))
    model.set_rules(dict(_fields(normalizer.serialized_normalizer_spec())))
    encoder = PieceEncoder(model)
    for text in [*awkward_texts(300), "ﬁ  Ａ①x　é ㍿ ", "　a　", "ｶﾞ é"]:
        made, origin = model.normalise(text)
        want, places = normalizer.normalize(text, with_offsets=True)
        assert made == want
        raw, ends = text.encode(), np.cumsum([0] + [len(c.encode()) for c in made])
        if made:
            assert [len(raw[:origin[e]].decode()) for e in ends] == places
        ids, begins, stops = encoder(text)
        assert len(ids) == len(begins) and (begins <= stops).all()


def test_merge_takes_the_best_pair_and_the_leftmost_of_equals():
    known = {"ab": (1.0, 0), "bc": (0.5, 1), "abc": (2.0, 2), "aa": (3.0, 3), "aaa": (3.0, 4)}
    assert merge("abc", known) == ["abc"]
    assert merge("aaaaa", known) == ["aaa", "aa"]
    assert merge("", known) == []


def test_encoded_tables(spark, library):
    got = {(r["doc_id"], r["ids_sha256"]): r for r in encode_pieces(messy(spark), MODEL).collect()}
    for i, text, *_ in messy_rows():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        row = got[(i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())]
        assert row["n_tokens"] == len(ids) and row["ids"] == ids
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert row["stops"][-1] == len((text or "").encode())
    back = decode_pieces(encode_pieces(messy(spark), MODEL), MODEL)
    assert rows_of(back, "doc_id", "text") == sorted(((i, library.decode(library.encode(t or ""))) for i, t, *_ in messy_rows()), key=repr)
    assert encode_pieces(empty(spark), MODEL, with_pieces=False).collect() == []


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="only BPE"):
        Model(b"")


# -- near duplicates without id -----------------------------------------------------------------

def test_rows_without_id_link_others(spark):
    """Near copies of a document, and a chain that only a row without id closes."""
    base = prose(21, 200).split()

    def changed(*places):
        return " ".join("other" + str(p) if p in places else w for p, w in enumerate(base))
    far = prose(22, 150)
    rows = [(1, changed()), (None, changed(100)), (None, changed(100)), (None, changed(100, 40)), (7, changed(100, 40, 160)), (8, far), (None, far + " end"), (None, prose(23, 90))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).drop("text_hash")
    assert rows_of(got, *got.columns) == brute_components(rows)
    assert got.where("doc_id IS NULL AND kept").count() == 1 and got.where("doc_id = 7").first()["component_id"] == 1


# -- frequent bigrams ------------------------------------------------------------------------------

@pytest.mark.parametrize("pairs", [0, 1, 3, 1 << 20])
def test_scores_do_not_depend_on_the_bigrams_sent(spark, pairs):
    texts = ["a b c a b", "a b a b a b rare", "b c b c odd a b", "c a b", "", None, "a b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    names = ("doc_id", "n_words", "n_backoff", "log_score")
    assert rows_of(lm_scores(docs, hot_pairs=pairs), *names) == rows_of(lm_scores(docs, hot=0), *names)
    assert rows_of(lm_scores(docs, hot_pairs=pairs, vocabulary=2), *names) == rows_of(lm_scores(docs, hot_pairs=0, vocabulary=2), *names)
