"""Benchmark passages inside documents, found by spaced seeds and confirmed word by word.

Words are cut after ASCII punctuation is deleted and A-Z is folded. A document holds a benchmark
item if, laid over each other at some offset, at least 10 words of 13 neighbouring places are equal;
an item of 6 to 9 words must occur whole, a shorter one is never found. The six masks below look
at 6 places each and ignore the others. Whatever 3 of 13 places differ, one of them fits between, so
equal seeds lead to every such overlap (tested for all 286 patterns).
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.bitmap import bitmap, holds
from shoal.llm.words import WordHasher, row_numbers, slices, windows
from shoal.session import materialise

#: Fixed masks: the places of a seed that count.
MASKS = [(0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 6, 7), (0, 1, 4, 7, 8, 9), (0, 1, 4, 6, 9, 10), (0, 1, 5, 6, 8, 9), (0, 3, 5, 6, 8, 12)]
SPAN, EQUAL = 13, 10
SEED_BITS = 26


def _hasher() -> WordHasher:
    return WordHasher(fold=True, drop=string.punctuation.encode())


def _seeds(hashes: np.ndarray, starts: np.ndarray):
    """(seed hashes, which lie in their text) for each mask."""
    for i, mask in enumerate(MASKS):
        yield windows(hashes, starts, mask[-1] + 1, seed=100 + i, at=mask)


def _seed_table(rows: DataFrame, id_name: str, bits: np.ndarray | None = None) -> DataFrame:
    """(seed, id, pos) of all texts; with ``bits`` only seeds that may be in the bitmap."""
    def task(batches):
        hasher = _hasher()
        for part in slices(batches, "text"):
            hashes, starts = hasher(part.column("text"))
            row = row_numbers(starts)
            for seeds, inside in _seeds(hashes, starts):
                at = np.flatnonzero(inside & holds(bits, seeds) if bits is not None else inside)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seeds[at].view(np.int64)), part.column("key").take(pa.array(row[at])),
                     pa.array(at - starts[row[at]])], ["seed", id_name, "pos"])
    return rows.mapInArrow(task, f"seed long, {id_name} long, pos long")


def overlaps(doc: np.ndarray, item: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """Word ranges of ``doc`` that agree with ``item`` laid over it from word ``shift`` on."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    same = np.flatnonzero(item[a:b] == doc[a + shift:b + shift]) + a + shift
    need, span = (EQUAL, SPAN) if len(item) >= EQUAL else (len(item), len(item))
    if need < len(MASKS[0]) or len(same) < need:
        return []
    ends = same[need - 1:]
    heads = same[:len(ends)]
    return [(int(x), int(y) + 1) for x, y in zip(heads, ends) if y - x < span]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", with_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: (doc_id, contaminated, n_items, items, n_words_hit).

    ``items`` are the item ids found, ascending and comma-joined; ``n_words_hit`` counts the words (after
    folding) inside confirmed overlaps. Null and empty texts hold nothing; items with null id or text are
    not searched for. Rows with a null doc_id or a repeated one are examined each by its own text;
    ``with_hash`` adds ``text_hash`` (xxhash64 of the text), which tells their results apart.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("key"), F.col(item_text).cast("string").alias("text")).where(
        "key IS NOT NULL AND text IS NOT NULL").distinct()
    test = materialise(_seed_table(items, "item").distinct(), "seeds")
    bits = bitmap(test, F.col("seed"), SEED_BITS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "text_hash", F.xxhash64("text")).withColumn("key", F.coalesce("doc_id", "text_hash"))
    hits = _seed_table(rows, "key", bits)
    found = (hits.join(test.withColumnRenamed("pos", "at"), "seed")
             .select("key", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct())

    def item_words(batches):
        hasher = _hasher()
        for part in slices(batches, "text"):
            hashes, starts = hasher(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(
                [hashes[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())], ["item", "words"])
    words = items.mapInArrow(item_words, "item long, words binary")
    found = materialise(found.join(words, "item").groupBy("key").agg(
        F.collect_list(F.struct("item", "shift", "words")).alias("found")), "found")
    doc_bits = bitmap(found, F.xxhash64("key"))

    def suspects(batches):
        for part in slices(batches, "text"):
            hit = holds(doc_bits, part.column("hash").to_numpy().view(np.uint64))
            texts = part.column("text").take(pa.array(np.arange(part.num_rows), mask=~hit))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), texts, part.column("text_hash")], ["doc_id", "key", "text", "text_hash"])

    def confirm(batches):
        hasher = _hasher()
        for part in slices(batches, "text"):
            hashes, starts = hasher(part.column("text"))
            out = []
            for i, tried in enumerate(part.column("found").to_pylist()):
                doc, ids, hit = hashes[starts[i]:starts[i + 1]], set(), set()
                for t in tried or ():
                    for a, b in overlaps(doc, np.frombuffer(t["words"], np.uint64), t["shift"]):
                        ids.add(t["item"])
                        hit.update(range(a, b))
                out.append((bool(ids), len(ids), ",".join(map(str, sorted(ids))), len(hit)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array([o[j] for o in out], t) for j, t in enumerate(
                    (pa.bool_(), pa.int64(), pa.string(), pa.int64()))), part.column("text_hash")],
                ["doc_id", "contaminated", "n_items", "items", "n_words_hit", "text_hash"])
    marked = rows.withColumn("hash", F.xxhash64("key")).mapInArrow(suspects, "doc_id long, key long, text string, text_hash long")
    out = (marked.join(found, "key", "left").select("doc_id", "text", "found", "text_hash")
           .mapInArrow(confirm, "doc_id long, contaminated boolean, n_items long, items string, n_words_hit long, text_hash long"))
    return out if with_hash else out.drop("text_hash")
