"""Stupid-backoff language-model scores of documents, computed as joins.

Words have A-Z folded. Word and bigram counts cover the whole corpus and every word. A document's
distinct bigrams are exploded and joined, by bigram, to the table of counts; the logarithms are summed
per document as whole millionths, so that the order of rows does not matter.

The counts of the ``HOT`` words of most documents are sent to all tasks, and so are those of the up to ``HOT_PAIRS``
most frequent bigrams of them; they only spare joins. All other
words are keyed by their 64-bit hashes: a bigram that holds one is counted by the hash of both, and gets
the counts of its words by joins on these. A word of a single text needs neither, since no other document
can hold its bigrams, and its count is known where it stands; a bitmap of fixed size tells these apart.

Where the second word of a bigram was sent, the document can add up its backoff by itself, and the join only corrects this
where another document holds the bigram. So bigrams of this kind that occur once are not written, shuffled or joined.

S(w | v) = (C(vw) - own) / C(v), where own is the document's own count of the bigram, if that is above 0;
else 0.4 * C(w) / N. The first word has S = C(w) / N. A document thus is scored by what others hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.bitmap import bitmap, holds
from shoal.llm.words import WordHasher, gathered, mix, row_numbers, slices, small_batches
from shoal.session import materialise

BACKOFF = 0.4
HOT = 1 << 18
HOT_PAIRS = 1 << 20
BLOCK_BYTES = 6 << 20
SHARED_BITS = 26
UNKNOWN = 0
STEP_BITS = 10
#: Keys of the join: below WORD two ids, from WORD on the hash of a word, from PAIR on that of a bigram, odd if its second word
#: was sent; rows of documents are negative.
WORD, PAIR = 1 << 61, 1 << 62


def _batches(names: list[str], *columns: np.ndarray):
    for a in range(0, len(columns[0]), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(c[a:a + (1 << 17)]) for c in columns], names)


def word_counts(rows: DataFrame) -> DataFrame:
    """(h, docs, n): documents and occurrences of each word, counted per block of texts first."""
    def task(batches):
        hasher = WordHasher(fold=True)
        for part in gathered(batches, "text", BLOCK_BYTES):
            hashes, starts = hasher(part.column("text"))
            order = np.argsort(hashes, kind="stable")  # texts stay in order inside a word
            h, doc = hashes[order], row_numbers(starts)[order]
            if not len(h):
                continue
            fresh = np.concatenate(([True], h[1:] != h[:-1]))
            heads = np.flatnonzero(fresh)
            docs = np.add.reduceat((fresh | np.concatenate(([True], doc[1:] != doc[:-1]))).astype(np.int64), heads)
            yield from _batches(["h", "docs", "n"], h[heads].view(np.int64), docs, np.diff(np.append(heads, len(h))))
    return rows.mapInArrow(task, "h long, docs long, n long").groupBy("h").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


class Numbering:
    """Ids of words: 1, 2, ... in the order of their hashes among the words sent, 0 for the rest."""

    def __init__(self, known: np.ndarray):
        # hashes are spread evenly: their first bits tell the place in the order, but for the few words that share them
        bits = min(20, len(known).bit_length() + 2)
        self.known, self.shift = np.append(known, np.uint64(2 ** 64 - 1)), np.uint64(64 - bits)
        self.first = np.searchsorted(known >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(self.first, append=len(known)).max())
        self.n = len(known)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = self.first[hashes >> self.shift]
        for _ in range(self.steps):
            place += self.known[place] < hashes
        return np.where((self.known[place] == hashes) & (place < self.n), place + 1, UNKNOWN).astype(np.int64)


def _neighbours(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, text number) of all neighbours in one text."""
    row = row_numbers(starts)
    at = np.flatnonzero(row[1:] == row[:-1])
    return at, row[at]


def _word_keys(hashes: np.ndarray) -> np.ndarray:
    return ((hashes & np.uint64(WORD - 1)) | np.uint64(WORD)).view(np.int64)


def _keys(hashes: np.ndarray, ids: np.ndarray, sent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the bigrams that begin at ``at``: their ids where both words were sent, else a hash of both."""
    pair = mix(mix(hashes[at]) * np.uint64(0x9E3779B97F4A7C55) + hashes[at + 1])
    pair = ((pair >> np.uint64(3)) << np.uint64(1)) | sent[at + 1] | np.uint64(PAIR)
    return np.where(sent[at] & sent[at + 1], (ids[at] << 32) | ids[at + 1], pair.view(np.int64))


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(fresh)


def _frequent(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, counts) of the most frequent of ``pairs`` (key, c): all down to some count, ``most`` at the most.

    The count is found from a histogram with steps of a thousandth, a few ten thousand rows whatever the number of pairs.
    """
    shift = F.greatest(F.length(F.bin("c")) - STEP_BITS, F.lit(0))
    step = F.call_function("shiftleft", F.call_function("shiftright", F.col("c"), shift), shift)
    held, least = 0, None
    for r in sorted(pairs.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        held += r["count"]
        if held > most:
            break
        least = r["s"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = pairs.where(F.col("c") >= least).toArrow()
    keys = found.column("key").to_numpy()
    order = np.argsort(keys)
    return keys[order], found.column("c").to_numpy()[order]


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None, hot: int = HOT,
              hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per document: (doc_id, n_words, n_backoff, log_score, mean_log_score).

    ``log_score`` is the sum of natural logarithms, ``n_backoff`` the number of words scored by the backoff.
    Null, empty or blank texts have no words, log_score 0 and a null mean. Rows with the same doc_id are
    one document whose texts never join into a bigram; rows with null doc_id count and are scored as one
    document. All words count as themselves. Only a caller who asks for a closed ``vocabulary`` gets the words
    beyond that number folded into one class, <unk>. ``hot`` and ``hot_pairs`` bound the tables of words and of bigrams
    that are sent to all tasks (16 bytes each) and have no part in the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    words = materialise(word_counts(rows), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    folds = vocabulary is not None
    top = words.orderBy(F.desc("docs"), "h").limit(vocabulary if folds else hot).select("h", "n").toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    known, n_known = h[order], top.column("n").to_numpy()[order]
    counts = np.concatenate(([total - int(n_known.sum())], n_known)).astype(np.int64)
    shared = bitmap(words.where("docs > 1"), F.col("h"), SHARED_BITS)
    shipped = spark.sparkContext.broadcast((known, counts, shared))  # the words sent and a bitmap, whatever the size of the corpus

    def numbered(part, hasher, number):
        """(hashes, first word of each text, ids, which words were sent, which of the others may stand in several texts)."""
        hashes, starts = hasher(part.column("text"))
        ids = number(hashes)
        sent = np.ones(len(ids), bool) if folds else ids != UNKNOWN
        return hashes, starts, ids, sent, ~sent & holds(shipped.value[2], hashes)

    def count_task(batches):
        """Counts of the bigrams that two texts may hold; for those with a word that was not sent, also the counts of the other."""
        hasher, number = WordHasher(fold=True), Numbering(shipped.value[0])
        for part in gathered(batches, "text", BLOCK_BYTES):
            hashes, starts, ids, sent, several = numbered(part, hasher, number)
            at = _neighbours(starts)[0]
            at = at[(sent | several)[at] & (sent | several)[at + 1]]
            keys, first, n = np.unique(_keys(hashes, ids, sent, at), return_index=True, return_counts=True)
            at = at[first]
            mixed = keys >= PAIR
            for a in range(0, len(keys), 1 << 17):
                z = slice(a, a + (1 << 17))
                sizes = [pa.array(shipped.value[1][ids[w[z]]], mask=~(mixed[z] & sent[w[z]])) for w in (at, at + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[z]), pa.array(n[z]), *sizes], ["key", "n", "c_v", "c_w"])

    def ask_task(batches):
        """(word, bigram, whether it is the first word of it): which counts the bigrams still need."""
        hasher, number = WordHasher(fold=True), Numbering(shipped.value[0])
        for part in gathered(batches, "text", BLOCK_BYTES):
            hashes, starts, ids, sent, several = numbered(part, hasher, number)
            at = _neighbours(starts)[0]
            at = at[(several[at] & (sent | several)[at + 1]) | (sent[at] & several[at + 1])]
            keys, first = np.unique(_keys(hashes, ids, sent, at), return_index=True)
            for word, is_first in ((at[first], True), (at[first] + 1, False)):
                need = several[word]
                yield from _batches(["name", "key", "is_first"], _word_keys(hashes[word[need]]), keys[need], np.full(int(need.sum()), is_first))

    def in_bitmap(batches):
        for batch in batches:
            yield batch.filter(pa.array(holds(shipped.value[2], batch.column("h").to_numpy().view(np.uint64))))

    ids = F.broadcast(spark.createDataFrame(pa.table({"id": np.arange(len(counts)), "count": np.maximum(counts, 1)})))  # the words sent again
    given = rows.mapInArrow(count_task, "key long, n long, c_v long, c_w long")
    if not folds:
        sent_words = F.broadcast(spark.createDataFrame(pa.table({"h": known.view(np.int64)}), "h long"))
        rare = (words.select("h", "n").mapInArrow(in_bitmap, "h long, n long").join(sent_words, "h", "left_anti")
                .select(F.col("h").bitwiseAND(WORD - 1).bitwiseOR(WORD).alias("name"), F.col("n").alias("count")))
        none = F.lit(0).cast("long").alias("n")
        asked = rows.mapInArrow(ask_task, "name long, key long, is_first boolean").join(rare, "name").select(
            "key", none, F.when(F.col("is_first"), F.col("count")).alias("c_v"), F.when(~F.col("is_first"), F.col("count")).alias("c_w"))
        given = given.unionByName(asked).unionByName(rare.select(F.col("name").alias("key"), none, F.lit(None).cast("long").alias("c_v"), F.col("count").alias("c_w")))
    own_backoff = (F.col("key") < WORD) | ((F.col("key") >= PAIR) & (F.col("key").bitwiseAND(1) == 1))  # documents know the count of the second word
    table = given.groupBy("key").agg(F.sum("n").alias("c"), F.max("c_v").alias("c_v"), F.max("c_w").alias("c_w"))
    table = materialise(table.where(~own_backoff | (F.col("c") > 1)), "bigrams")
    often = _frequent(table.where(F.col("key") < WORD).select("key", "c"), hot_pairs)
    sent_pairs = spark.sparkContext.broadcast(often)  # at most ``hot_pairs`` keys and counts
    table = table.where((F.col("key") >= WORD) | (F.col("c") < (int(often[1].min()) if len(often[1]) else 1 << 62)))
    for word, part in (("c_v", F.shiftright("key", 32)), ("c_w", F.col("key").bitwiseAND(0xFFFFFFFF))):
        table = (table.withColumn("id", F.when(F.col("key") < WORD, part)).join(ids, "id", "left")
                 .withColumn(word, F.coalesce(word, "count")).select("key", "c", "c_v", "c_w"))

    def logs(s):
        return np.floor(np.log(s) * 1e6 + 0.5).astype(np.int64)

    def explode_task(batches):
        """Bigrams of each document, by key, with their number in it. Word keys stand for bigrams that no other document
        holds, and with n = -1 for the first word. Rows with key -1 carry what needs no join: words, score and backoffs."""
        hasher, number = WordHasher(fold=True), Numbering(shipped.value[0])
        names = ["key", "doc", "n", "micro", "back"]
        for part in slices(batches, "text"):
            hashes, starts, ids, sent, several = numbered(part, hasher, number)
            doc, sizes = part.column("doc"), np.diff(starts)
            size = np.where(sent, shipped.value[1][ids], 0)  # occurrences of each word, 0 where a join must tell
            alone = np.flatnonzero(~sent & ~several)  # all of its occurrences stand in this text
            if len(alone):
                _, back, n = np.unique(hashes[alone], return_inverse=True, return_counts=True)
                size[alone] = n[back]
            at, row = _neighbours(starts)
            lone = (~sent & ~several)[at] | (~sent & ~several)[at + 1]
            here = lone & (size[at + 1] > 0)
            micro, backs = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(micro, row[here], logs(BACKOFF * size[at[here] + 1] / max(1, total)))
            np.add.at(backs, row[here], 1)
            firsts = np.flatnonzero(sizes > 0)
            begin = starts[:-1][firsts]
            told = size[begin] > 0
            micro[firsts[told]] += logs(size[begin[told]] / max(1, total))
            at, row, lone = at[~here], row[~here], lone[~here]
            second = np.where(sent, size, 0)[at + 1]
            keys = np.where(lone, _word_keys(hashes)[at + 1], _keys(hashes, ids, sent, at)) if len(at) else np.zeros(0, np.int64)
            order = np.argsort(keys, kind="stable")  # texts stay in order inside a bigram
            keys, row = keys[order], row[order]
            heads = _heads(keys, row)
            n = np.diff(np.append(heads, len(keys)))
            keys, row, second = keys[heads], row[heads], second[order[heads]]
            found, held = sent_pairs.value
            place = np.minimum(np.searchsorted(found, keys), max(0, len(found) - 1))
            told_pairs = found[place] == keys if len(found) else np.zeros(len(keys), bool)
            if told_pairs.any():  # frequent bigrams need no join
                k, m, left = keys[told_pairs], n[told_pairs], held[place[told_pairs]] - n[told_pairs]
                size_v, size_w = (np.maximum(shipped.value[1][w], 1) for w in (k >> 32, k & 0xFFFFFFFF))
                np.add.at(micro, row[told_pairs], m * np.where(left > 0, logs(np.maximum(left, 1) / size_v), logs(BACKOFF * size_w / max(1, total))))
                np.add.at(backs, row[told_pairs], np.where(left > 0, 0, m))
                keys, row, n, second = keys[~told_pairs], row[~told_pairs], n[~told_pairs], second[~told_pairs]
            own = second > 0  # counted as if no other document held the bigram; the join corrects it
            np.add.at(micro, row[own], n[own] * logs(BACKOFF * second[own] / max(1, total)))
            np.add.at(backs, row[own], n[own])
            keys = np.concatenate((keys, _word_keys(hashes[begin[~told]])))
            row = np.concatenate((row, firsts[~told]))
            n = np.concatenate((n, np.full(len(keys) - len(n), -1)))
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys), doc.take(pa.array(row)), pa.array(n), none, none], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), -1, np.int64)), doc, pa.array(sizes), pa.array(micro), pa.array(backs)], names)

    exploded = rows.mapInArrow(explode_task, "key long, doc long, n long, micro long, back long")
    spread = F.when(F.col("key") < 0, -1 - F.abs(F.xxhash64("doc") / 2).cast("long")).otherwise(F.col("key"))  # keys without partner, evenly
    joined = exploded.withColumn("key", spread).join(table, "key", "left")
    left = F.col("c") - F.col("n")

    def micros(share: Column) -> Column:
        return F.floor(F.log(share) * 1e6 + 0.5)
    text, first = F.col("micro").isNotNull(), F.col("n") < 0
    seen, unseen = F.col("n") * micros(left / F.col("c_v")), F.col("n") * micros(F.lit(BACKOFF) * F.col("c_w") / F.lit(float(max(1, total))))
    found = joined.groupBy("doc").agg(
        F.sum(F.when(text, F.col("n")).otherwise(0)).alias("n_words"),
        F.sum(F.when(text, F.col("back")).when(first, 0).when(own_backoff, F.when(left > 0, -F.col("n")).otherwise(0))
              .when(left > 0, 0).otherwise(F.col("n"))).alias("n_backoff"),
        F.sum(F.when(text, F.col("micro")).when(first, micros(F.col("c_w") / F.lit(float(max(1, total)))))
              .when(own_backoff, F.when(left > 0, seen - unseen).otherwise(0)).when(left > 0, seen).otherwise(unseen)).alias("micro"))
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_backoff", (F.col("micro") / 1e6).alias("log_score"),
                        F.when(F.col("n_words") > 0, F.col("micro") / 1e6 / F.col("n_words")).alias("mean_log_score"))
