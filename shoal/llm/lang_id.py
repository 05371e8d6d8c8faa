"""Language identification by the nearest of several centroids per language.

Texts become TF-IDF vectors of character n-grams (one to three, letters only, words bounded by
blanks), hashed to a fixed number of places and normalised. Each language keeps a few centroids,
clustered by cosine from a bounded sample of its labelled documents; a text takes the language of
the nearest centroid and is rejected if it is farther from it than that language ever is in the
sample, by a wide factor.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.words import mix, numbers, slices

PLACES = 1 << 13
ORDERS = (1, 2, 3)
CHUNK = 1 << 18


def letter_table() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or 0 where it is none."""
    table = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Profiler:
    """Counts of hashed n-grams of whole texts, computed in chunks of bounded size."""

    def __init__(self, places: int = PLACES):
        self.table, self.places = letter_table(), places
        self.constants = numbers(77, max(ORDERS))

    def _letters(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        out = self.table[np.minimum(codes, 0xFFFF)]
        far = codes > 0xFFFF
        if far.any():
            out[far] = [c if unicodedata.category(chr(c))[0] == "L" else 0 for c in codes[far].tolist()]
        return out

    def counts(self, text: str) -> np.ndarray:
        """How often each place occurs; the border of a word counts as one blank, other signs not at all."""
        total = np.zeros(self.places, np.float32)
        for at in range(0, len(text), CHUNK):
            codes = self._letters(" " + text[at:at + CHUNK + max(ORDERS) - 1] + " " if at == 0 else text[at - 1:at + CHUNK + max(ORDERS) - 1])
            some = codes > 0
            keep = some | np.concatenate(([False], some[:-1]))  # letters, and one blank after each word
            codes = codes[keep].astype(np.uint64) + np.uint64(1)
            for k in ORDERS:
                if len(codes) < k:
                    continue
                h = np.full(len(codes) - k + 1, k, np.uint64)
                for j in range(k):
                    h += codes[j:len(codes) - k + 1 + j] * self.constants[j]
                letters = codes[:len(codes) - k + 1] > 1 if k == 1 else slice(None)
                total += np.bincount((mix(h[letters]) >> np.uint64(40)).astype(np.int64) % self.places, minlength=self.places).astype(np.float32)
        return total

    def has_letter(self, text: str | None) -> bool:
        return bool(text) and any(self._letters(text[at:at + CHUNK]).any() for at in range(0, len(text), CHUNK))

    def tf(self, texts: list[str]) -> np.ndarray:
        """(texts x places): one plus the logarithm of each count."""
        out = np.zeros((len(texts), self.places), np.float32)
        for i, text in enumerate(texts):
            counts = self.counts(text)
            at = np.flatnonzero(counts)
            out[i, at] = 1 + np.log(counts[at])
        return out


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, steps: int = 15, least: float = 0.05) -> np.ndarray:
    """Centroids by cosine, from rows spread evenly over ``x``; clusters of less than ``least`` of the rows are left out."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(steps):
        own = (x @ centres.T).argmax(axis=1)
        moved = normalised(np.array([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))]))
        if np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    sizes = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres))
    return centres[sizes >= max(1, least * len(x))]


@dataclass
class LanguageModel:
    """Centroids (rows), the language of each, inverse document frequencies, and the smallest accepted cosine per language."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    accepted: np.ndarray

    def classify(self, tf: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine to its nearest centroid, rejected) of each row; ties go to the first language."""
        near = normalised(tf * self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(near)), best], 0.0, 1.0)
        owner = self.owner[best]
        return [self.languages[o] for o in owner], score, score < self.accepted[owner]


def fit_languages(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = 400, clusters: int = 4,
                  slack: float = 0.25, max_languages: int = 1000) -> LanguageModel | None:
    """Fit on about ``per_language`` documents of each language, drawn by a hash of the text.

    ``per_language`` bounds the sample the driver fits on, as sparse vectors; ``max_languages`` guards the
    number of groups. Rows with null language or without letters teach nothing. ``slack`` is the part of the
    sample's smallest cosine below which a text is rejected. None without any usable row.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    if not counts:
        return None
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    unit = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)

    def task(batches):
        profiler = Profiler()
        for part in slices(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                tf = profiler.tf([text])[0]
                at = np.flatnonzero(tf)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype(np.int32)]), pa.array([tf[at]])], ["lang", "places", "tf"])
    # exact copies draw the same number: one of each teaches
    drawn = rows.where(unit < F.element_at(share, F.col("lang"))).withColumn("h", F.xxhash64("text")).dropDuplicates(["lang", "h"])
    sample = (drawn.select("lang", "text").mapInArrow(task, "lang string, places array<int>, tf array<float>")
              .orderBy("lang", F.xxhash64("places", "tf")).limit(2 * per_language * len(counts) + 100).toArrow().to_pylist())
    if not sample:
        return None
    x = np.zeros((len(sample), PLACES), np.float32)
    for i, row in enumerate(sample):
        x[i, row["places"]] = row["tf"]
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = normalised(x * idf)
    langs = np.array([row["lang"] for row in sample])
    names, centroids, owner, accepted = sorted(set(langs.tolist())), [], [], []
    for i, name in enumerate(names):
        own = x[langs == name]
        centres = cluster(own, clusters)
        centroids.append(centres)
        owner += [i] * len(centres)
        accepted.append(slack * float((own @ centres.T).max(axis=1).min()))
    return LanguageModel(names, np.array(owner), np.concatenate(centroids).astype(np.float32), idf, np.array(accepted))


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: (doc_id, lang_pred, score, rejected).

    ``lang_pred`` is a learned language, or ``und`` where the text is null, empty or without a letter, or
    nothing was learned; then score is 0 and rejected is true. Only the text decides, so repeated rows
    agree. ``keep`` names further columns to carry.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)  # centroids: clusters x languages x places
    names = ["doc_id", "lang_pred", "score", "rejected"]
    carried = [c for c in keep if c not in names]
    moved = [c for c in carried if c != text_col or docs.schema[c].dataType.simpleString() != "string"]  # the text itself travels once

    def task(batches):
        profiler, model = Profiler(), LanguageModel(**shipped.value) if shipped.value else None
        for big in slices(batches, "__text"):
            for at in range(0, big.num_rows, 512):
                part = big.slice(at, 512)
                texts = part.column("__text").to_pylist()
                langs, scores, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if model is not None:
                    tf = profiler.tf([t or "" for t in texts])
                    lettered = np.flatnonzero(tf.any(axis=1))
                    if len(lettered):
                        found, score, rejected = model.classify(tf[lettered])
                        scores[lettered], out[lettered] = score, rejected
                        for i, lang in zip(lettered, found):
                            langs[i] = lang
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores.astype(float)), pa.array(out),
                     *(part.column(c if c in moved else "__text") for c in carried)], names + carried)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"), *[F.col(f"`{c}`") for c in moved])
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(task, "doc_id long, lang_pred string, score double, rejected boolean" + extra)


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
