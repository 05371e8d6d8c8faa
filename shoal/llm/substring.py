"""Passages repeated across documents, by an exact join of 13-word windows.

The reference of a document is every document with a smaller id. An index maps each window of 13
words that may repeat to the smallest document of the corpus it starts in. Every word covered by a
window found there is removed. Factors are what the SQL of the query counts: runs of consecutive found
windows with the same source document. They are not those of a relative Lempel-Ziv parsing: the index
holds no positions, no factor is extended along its source, and factors decide nothing about removal.

Only windows whose anchor (the smallest hash among their eight runs of six words) occurs twice in
the corpus are indexed. Each task first gathers the documents of a window inside its own block, so
that a passage found in a third of all documents reaches the index as one row per block. Windows are
64-bit hashes: with 10^12 indexed windows, one in 10^7 might be taken for another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.bitmap import bitmap, holds
from shoal.llm.words import WordHasher, gathered, row_numbers, slices, windows
from shoal.session import materialise

WINDOW, RUN = 13, 6
BLOCK_BYTES = 24 << 20
ANCHOR_BITS = 26


def _anchors(hashes: np.ndarray, starts: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of the window at each word, whether the window lies in its text)."""
    runs, _ = windows(hashes, starts, run, seed=11)
    doc_end = np.repeat(starts[1:], np.diff(starts))
    least = runs.copy()
    for j in range(1, window - run + 1):
        least[:-j] = np.minimum(least[:-j], runs[j:])
    return least, np.arange(len(hashes)) + window <= doc_end


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Marks what differs from its left neighbour."""
    fresh = np.ones(len(keys[0]), bool)
    if len(fresh):
        fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return fresh


def _shared_anchors(rows: DataFrame, window: int, run: int) -> DataFrame:
    """Anchors of two documents, or of two blocks, which hold different documents."""
    def task(batches):
        hasher = WordHasher()
        for part in gathered(batches, "text", BLOCK_BYTES):
            hashes, starts = hasher(part.column("text"))
            least, inside = _anchors(hashes, starts, window, run)
            doc, least = row_numbers(starts)[inside], least[inside]
            some = _heads(least, doc)
            least, doc = least[some], doc[some]
            order = np.lexsort((doc, least))
            least, doc = least[order], doc[order]
            heads = np.flatnonzero(_heads(least))
            tails = np.append(heads[1:], len(least))[:len(heads)] - 1
            many = np.where(doc[heads] != doc[tails], 2, 1)
            for a in range(0, len(heads), 1 << 17):
                z = slice(a, a + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(least[heads[z]].view(np.int64)), pa.array(many[z])], ["anchor", "n"])
    return rows.mapInArrow(task, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc, h, ref): windows of a document that also stand in a smaller one; ``ref`` is the smallest of the corpus."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL")
    bits = bitmap(_shared_anchors(rows, window, run), F.col("anchor"), ANCHOR_BITS)

    def task(batches):
        hasher = WordHasher()
        for part in gathered(batches, "text", BLOCK_BYTES):
            hashes, starts = hasher(part.column("text"))
            least, inside = _anchors(hashes, starts, window, run)
            at = np.flatnonzero(inside & holds(bits, least))
            doc = part.column("doc").to_numpy()[row_numbers(starts)[at]]
            h = windows(hashes, starts, window, seed=13)[0][at]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            fresh = _heads(h, doc)
            h, doc = h[fresh], doc[fresh]
            heads = np.flatnonzero(_heads(h))
            ends = np.append(heads[1:], len(h))[:len(heads)]
            for a in range(0, len(heads), 1 << 16):  # a window of the block, with all its documents there
                z = slice(a, a + (1 << 16))
                first, last = heads[z][0], ends[z][-1]
                offsets = pa.array(np.append(heads[z] - first, last - first).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(h[heads[z]].view(np.int64)), pa.array(doc[heads[z]]),
                                                  pa.ListArray.from_arrays(offsets, pa.array(doc[first:last]))], ["h", "ref", "docs"])
    found = rows.mapInArrow(task, "h long, ref long, docs array<long>")
    # one row per window and block meets the others; its documents travel with it, so all get the same source
    index = found.withColumn("ref", F.min("ref").over(Window.partitionBy("h"))).where(
        (F.size("docs") > 1) | (F.col("ref") < F.get("docs", F.lit(0))))
    return index.select("h", "ref", F.explode("docs").alias("doc")).where(F.col("ref") < F.col("doc")).select("doc", "h", "ref")


def parse(h: np.ndarray, known: np.ndarray, refs: np.ndarray, window: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(which words are covered, factors (first word, end, source)) of one text with window hashes ``h``."""
    covered = np.zeros(len(h) + window - 1 if len(h) else 0, bool)
    order = np.argsort(known)
    known, refs = known[order], refs[order]
    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
    found = np.flatnonzero(known[place] == h)
    if not len(found):
        return covered, []
    source = refs[place[found]]
    heads = np.concatenate(([True], (np.diff(found) != 1) | (source[1:] != source[:-1])))
    firsts = np.flatnonzero(heads)
    lasts = np.append(firsts[1:], len(found)) - 1
    spans = [(int(found[a]), int(found[b]) + window, int(source[a])) for a, b in zip(firsts, lasts)]
    for a, b, _ in spans:
        covered[a:b] = True
    return covered, spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_removed, kept_text, n_factors, spans).

    Removes each word covered by a window of ``window`` words that also starts in a document with a
    smaller doc_id, all judged on the input. ``kept_text`` is the words left, joined by one space;
    ``spans`` lists the factors as first word:end word:source, comma-joined. A null text has no words.
    A row with null doc_id is neither parsed nor a reference. Rows with the same doc_id are one document:
    they never repeat each other, and what repeats in a smaller one is removed from each.
    """
    known = materialise(repeated_windows(docs, id_col, text_col, window, run).groupBy("doc").agg(
        F.collect_list("h").alias("known"), F.collect_list("ref").alias("refs")), "repeats")
    bits = bitmap(known, F.xxhash64("doc"))

    def untouched(batches):
        for part in slices(batches, "text"):
            hit = holds(bits, part.column("hash").to_numpy().view(np.uint64)) & part.column("doc").is_valid().to_numpy(zero_copy_only=False)
            texts = part.column("text").to_pylist()
            words = [None if y else (x or "").encode().split() for x, y in zip(texts, hit)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array([None if w is None else len(w) for w in words], pa.int64()),
                 pa.array([None if w is None else b" ".join(w).decode() for w in words], pa.string()),
                 pa.array([x or "" if y else None for x, y in zip(texts, hit)], pa.string())], ["doc", "n_words", "kept_text", "text"])

    def touched(batches):
        hasher = WordHasher()
        for part in slices(batches, "text"):
            hashes, starts = hasher(part.column("text"))
            h = windows(hashes, starts, window, seed=13)[0].view(np.int64)
            texts, known_of, refs_of = (part.column(c).to_pylist() if c == "text" else part.column(c) for c in ("text", "known", "refs"))
            out = []
            for i, text in enumerate(texts):
                if text is None:
                    out.append((part.column("n_words")[i].as_py(), 0, part.column("kept_text")[i].as_py(), 0, ""))
                    continue
                words, spans, covered = text.encode().split(), [], ()
                if known_of[i].is_valid and len(words) >= window:
                    covered, spans = parse(h[starts[i]:starts[i + 1] - window + 1], known_of[i].values.to_numpy(),
                                           refs_of[i].values.to_numpy(), window)
                kept = [w for w, c in zip(words, covered) if not c] if spans else words
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), len(spans),
                            ",".join(f"{a}:{b}:{r}" for a, b, r in spans)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), *(pa.array([o[j] for o in out], t) for j, t in enumerate(
                    (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())))],
                ["doc_id", "n_words", "n_removed", "kept_text", "n_factors", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(id_col).cast("long")).alias("hash"),
                       F.col(text_col).cast("string").alias("text"))
    first = rows.mapInArrow(untouched, "doc long, n_words long, kept_text string, text string")
    return (first.join(known, "doc", "left").select("doc", "n_words", "kept_text", "text", "known", "refs")
            .mapInArrow(touched, "doc_id long, n_words long, n_removed long, kept_text string, n_factors long, spans string"))
