"""What the second review found missing."""

import collections
import math
import random
import string

import pytest

from shoal.llm import lm_score, substring
from shoal.llm.lm_score import lm_scores
from shoal.llm.secrets import GuessCost, find_spans, redacted
from shoal.llm.substring import remove_repeats


def cut(text):
    return text.lower().split()


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("hot, bits", [(0, 26), (3, 26), (3, 6)])
def test_lm_words_beyond_those_sent_count_as_themselves(spark, monkeypatch, hot, bits):
    monkeypatch.setattr(lm_score, "SHARED_BITS", bits)  # 64 places: most words pass for shared ones
    given = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "rare a b rare odd rare odd"), (2, "a b odd c rare odd twice"), (3, "b a only only twice b a"), (4, "x y"), (5, "x y z a b")], given)
    want = rows_of(lm_scores(docs), "doc_id", "n_words", "n_backoff", "log_score")
    assert rows_of(lm_scores(docs, hot=hot), "doc_id", "n_words", "n_backoff", "log_score") == want
    texts = [cut(r["text"]) for r in docs.orderBy("doc_id").collect()]
    uni = collections.Counter(w for t in texts for w in t)
    bi = sum((collections.Counter(zip(t, t[1:])) for t in texts), collections.Counter())
    for (i, n_words, n_backoff, score), t in zip(want, texts):
        own, total = collections.Counter(zip(t, t[1:])), sum(uni.values())
        s = [math.log(uni[t[0]] / total)] + [math.log((bi[p] - n) / uni[p[0]] if bi[p] > n else 0.4 * uni[p[1]] / total) for p, n in own.items() for _ in range(n)]
        assert (n_words, n_backoff) == (len(t), sum(n for p, n in own.items() if bi[p] <= n)) and score == pytest.approx(sum(s), abs=1e-4)


def test_secrets_of_any_length_and_of_letters():
    rng, cost = random.Random(5), GuessCost()

    def value(n, signs=string.ascii_letters + string.digits):
        return "".join(rng.choice(signs) for _ in range(n))
    for text, secret in [(f'credential = "{v}" end', v) for v in (value(3000), value(257))] + [
            (f'pwd="{v}"', v) for v in ("QzXvKpLmWrTyHs", "h7!Gk2#L", "q7mzk2xv9t")] + [(f"Authorization: Bearer {v}", v) for v in (value(40), value(400))]:
        spans = find_spans(text, cost)[0]
        assert ("cost", secret) in [(k, text[a:b]) for a, b, k in spans] and secret[-6:] not in redacted(text, spans)
    for text in ("the bearer certificates", "login is international", 'pwd="passwordpassword"', "passphrase: qwertyuiop123456", "pwd=" + "x" * 100_000):
        assert not find_spans(text, cost)[0]


@pytest.mark.parametrize("block", [1, 220, 1 << 20])
def test_factors_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    long = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(long + [f"only{i}" for i in range(10)])), (2, " ".join(long[:20])), (3, " ".join(long)), (4, " ".join(long[10:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    got = {r["doc_id"]: (r["n_removed"], r["n_factors"], r["spans"]) for r in remove_repeats(docs).collect()}
    assert got == {1: (0, 0, ""), 2: (20, 1, "0:20:1"), 3: (40, 1, "0:40:1"), 4: (30, 1, "0:30:1")}
