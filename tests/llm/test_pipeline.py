"""The pipeline against plain versions of its decisions, stage by stage."""

import hashlib

import corpus_pipeline
import public_tokenizers
from llm_data import messy, messy_rows
from test_llm_operators import brute_components, brute_overlap, cut
from tokenizers import Tokenizer

from shoal.llm.secrets import GuessCost, find_spans, redacted


def test_stages_on_given_tables(spark, sf_dir, tmp_path):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [tuple(r) for r in given.select(*corpus_pipeline.COLUMNS).collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    state = given
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, state, sf_dir).write.parquet(f"{tmp_path}/{name}")
        state = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "language ID":
            docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
        elif name == "near-duplicate removal":
            kept = {r[0] for r in brute_components(docs, 80) if r[3]}
            docs = [d for d in docs if d[0] in kept]
        elif name == "benchmark decontamination":
            import re
            clean = [cut(re.sub(r"[!-/:-@\[-`{-~]", "", t), fold=True) for t in items]
            words = [set(zip(c, c[1:])) for c in clean]

            def dirty(text):
                d = cut(re.sub(r"[!-/:-@\[-`{-~]", "", text or ""), fold=True)
                pairs = set(zip(d, d[1:]))
                return any(len(pairs & w) >= 3 and brute_overlap(d, c) for c, w in zip(clean, words))
            docs = [d for d in docs if not dirty(d[1])]
        elif name == "secret scan":
            cost = GuessCost()
            docs = [(i, redacted(t or "", find_spans(t or "", cost)[0]) if t else t, a, b, n) for i, t, a, b, n in docs]
            docs = [(i, t, a, b, n if "[secret]" not in (t or "") else len(t)) for i, t, a, b, n in docs]
        if name != "BPE":
            assert state.columns == corpus_pipeline.COLUMNS
            assert sorted(map(tuple, state.collect()), key=repr) == sorted(docs, key=repr), name
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d[0]: library.encode(d[1] or "", add_special_tokens=False).ids for d in docs}
    assert {r["doc_id"]: r["ids"] for r in state.collect()} == want
    assert {r["doc_id"]: r["decoded_sha256"] for r in state.collect()} == {d[0]: hashlib.sha256((d[1] or "").encode()).hexdigest() for d in docs}
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, run.collect()), key=repr) == sorted(map(tuple, state.collect()), key=repr)


def test_stages_survive_awkward_rows(spark, sf_dir):
    docs = messy(spark)
    language = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert language.columns == corpus_pipeline.COLUMNS
    near = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    kept = {r[0] for r in brute_components(messy_rows(), 80) if r[3]}
    assert sorted((r["doc_id"] for r in near.collect()), key=repr) == sorted(kept, key=repr)
    assert near.where("doc_id IS NULL AND text IS NOT NULL").count() == 0
    assert corpus_pipeline.decontamination(spark, docs, sf_dir).count() == len(messy_rows())
    assert corpus_pipeline.secret_scan(spark, docs, sf_dir).count() == len(messy_rows())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_decontamination_judges_each_row_by_its_text(spark, sf_dir):
    """Clean rows that share a null or a repeated doc_id with a contaminated one stay."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    dirty, clean = f"before {item} after", "nothing of the kind stands in here"
    rows = [(None, dirty, "en", "a", 1), (None, clean, "en", "a", 1), (5, dirty, "en", "a", 1), (5, clean, "en", "a", 1),
            (6, clean, "en", "a", 1), (7, None, None, None, None), (None, None, None, None, None), (5, clean, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.decontamination(spark, docs, sf_dir)
    assert sorted(map(tuple, left.collect()), key=repr) == sorted((r for r in rows if r[1] != dirty), key=repr)
