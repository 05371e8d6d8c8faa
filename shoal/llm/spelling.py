"""Spelling variants: words one edit apart, each led to the most frequent of its neighbours.

Words that differ by one inserted, deleted or replaced letter agree in the first or the second half of the
shorter one, so they meet under one of these halves; groups that are too large are halved again, until the
part that may differ is a single letter and the alphabet bounds the group. Inside a group the sorted words
are scanned with a banded edit matrix: a word keeps the rows of the prefix it shares with the word before,
and a prefix that is already more than one edit away skips all words that share it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.words import slices
from shoal.session import materialise

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
NOISE = 199
GROUP_WORDS = 2_000  #: larger groups are halved again
GROUP_BYTES = 1 << 20
HELD_WORDS = 200_000  #: words a task counts before it passes them on
LETTERS = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PARTIAL = "word string, n_near long, most long, form string"


def corrupted(run: str, prefix: int, noise: int) -> str:
    """The run without one letter if ``noise`` divides the crc32 of ``<doc_id>:<run>``; ``prefix``: crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, noise: int | None = NOISE) -> DataFrame:
    """(word, n) of the words of all texts with at least ``least_length`` letters and ``least_count`` occurrences.

    Words are maximal runs of ASCII letters, lower-cased, and U+00C0 to U+00FF, kept as they are. With ``noise``, one letter
    of every ``noise``-th (document, word) is deleted, chosen by crc32; a null doc_id counts as an empty one. Null texts have no words.
    """
    def task(batches):
        counts: Counter = Counter()

        def flush():
            words = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])
            counts.clear()

        for part in slices(batches, "text"):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                runs = Counter(RUN.findall((text.as_py() or "").encode().translate(LETTERS).decode()))
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs.items():
                    if len(run) >= least_length:
                        word = corrupted(run, prefix, noise) if noise else run
                        if len(word) >= least_length:
                            counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(task, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def scan(query: str, words: list[str], shared: list[int]) -> list[int]:
    """Which of the sorted ``words`` are exactly one edit from ``query``; ``shared[i]`` letters open both words i - 1 and i."""
    size, far = len(query), 2
    rows = [(far, 0, 1)]  # per letter read: edits to the query's first letters, one fewer, as many, one more
    found, i, n, depth = [], 0, len(words), 0
    while i < n:
        word = words[i]
        depth = min(depth, shared[i])
        del rows[depth + 1:]
        below, same, above = rows[depth]
        last = len(word)
        while depth < last:
            letter = word[depth]
            cost = below if 0 < depth <= size and query[depth - 1] == letter else below + 1
            below, up = (cost if cost <= same else same + 1), same
            cost = up if depth < size and query[depth] == letter else up + 1
            same = min(cost, above + 1, below + 1)
            cost = above if depth + 1 < size and query[depth + 1] == letter else above + 1
            above = min(cost, same + 1) if depth + 2 <= size else far
            if depth >= size:
                same = far
            if depth > size:
                below = far
            if below > 1 and same > 1 and above > 1:
                break
            depth += 1
            rows.append((below, same, above))
        if depth < last:  # no word that opens with these letters can be near
            i += 1
            while i < n and shared[i] > depth:
                i += 1
            continue
        gap = size - last
        if -1 <= gap <= 1 and (below, same, above)[gap + 1] == 1:
            found.append(i)
        i += 1
    return found


def near_in_group(start: int, tail: int, base: int, words: list[str], counts: list[int]) -> list[tuple[str, int, int, str]]:
    """(word, near words in this group, largest count among them, the word that has it; of equals the first in code-point order).

    All words agree but for the letters from ``start`` to ``tail`` before the end: ``base`` letters, or one more. Pairs of
    longer words belong to another group; so do pairs that also agree in the first half of what this group's tail was cut from.
    """
    middles = sorted((w[start:len(w) - tail], w, n) for w, n in zip(words, counts))
    keys = [m for m, _, _ in middles]
    shared = [0]
    for a, b in zip(keys, keys[1:]):
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        shared.append(k)
    out = []
    for query, word, _ in middles:
        most, form, near = 0, "", 0
        for i in scan(query, keys, shared):
            other, name, n = middles[i]
            if len(query) > base and len(other) > base:
                continue
            if tail and len(query) != len(other) and (query.startswith(other) or other.startswith(query)):
                continue  # met in the group of their first half as well
            near += 1
            if n > most or n == most and name < form:
                most, form = n, name
        if near:
            out.append((word, near, most, form))
    return out


def _halves(base):
    """(start, tail, base) of the two groups of words that differ only in the first, or only in the second half of their middle."""
    half = F.floor(base / 2).cast("int")
    return [(F.col("start") + half, F.col("tail"), base - half), (F.col("start"), F.col("tail") + base - half, half)]


def _keyed(rows: DataFrame, groups: list) -> DataFrame:
    """``rows`` (word, n) once for every group (start, tail, base); groups have the letters that all of their words share."""
    each = F.explode(F.array(*[F.struct(s.cast("int").alias("start"), t.cast("int").alias("tail"), b.cast("int").alias("base")) for s, t, b in groups]))
    rows = rows.select("word", "n", each.alias("g")).select("word", "n", "g.*").where(F.col("start").isNotNull())
    tail = F.substring(F.col("word"), F.length("word") - F.col("tail") + 1, F.col("tail"))
    return rows.select("start", "tail", "base", F.substring(F.col("word"), F.lit(1), F.col("start")).alias("opening"), tail.alias("ending"), "word", "n")


KEY = ["start", "tail", "base", "opening", "ending"]


def near_words(words: DataFrame, group_words: int | None = None) -> DataFrame:
    """(word, n_near, most, form) for the words of ``words`` (word, n; distinct) that have a word one edit away."""
    limit = group_words or GROUP_WORDS

    def task(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                start, tail, base = (batch.column(c)[k].as_py() for c in ("start", "tail", "base"))
                members = batch.column("members")[k].values
                out += near_in_group(start, tail, base, members.field("word").to_pylist(), members.field("n").to_pylist())
                if len(out) > HELD_WORDS:
                    yield made(out)
                    out = []
            yield made(out)

    def made(out):
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                          ["word", "n_near", "most", "form"])

    # every length meets its own and the next one; of the shorter one, no word is below the least length of all words
    least = F.length("word") > (words.agg(F.min(F.length("word"))).first()[0] or 0)
    own, less = F.length("word"), F.when(least, F.length("word") - 1)
    at = words.withColumn("start", F.lit(0)).withColumn("tail", F.lit(0))
    rows = materialise(_keyed(at, [g for base in (own, less) for g in _halves(base)]), "spelling")
    parts = []
    while True:
        sizes = rows.groupBy(*KEY).agg(F.count("*").alias("size"), F.sum(F.octet_length("word")).alias("bytes"))
        # one letter that may differ: the alphabet bounds the group
        large = sizes.where(((F.col("size") > limit) | (F.col("bytes") > GROUP_BYTES) & (F.col("size") > 2)) & (F.col("base") > 1))
        large = materialise(large.select(*KEY), "spelling-large")
        split = not large.isEmpty()
        small = rows.join(large, KEY, "left_anti") if split else rows
        groups = small.groupBy(*KEY).agg(F.collect_list(F.struct("word", "n")).alias("members"), F.min(F.length("word")).alias("least"))
        # a group without a word of the shorter length, or with one word, has no pair
        groups = groups.where((F.size("members") > 1) & (F.col("least") - F.col("start") - F.col("tail") == F.col("base")))
        parts.append(materialise(groups.select("start", "tail", "base", "members").mapInArrow(task, PARTIAL), "spelling-near"))
        if not split:
            break
        rows = materialise(_keyed(rows.join(large, KEY, "left_semi"), _halves(F.col("base"))), "spelling")
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    best = F.min(F.struct((-F.col("most")).alias("less"), "form"))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("most"), "b.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last word that forms lead to, found by doubling the steps.

    A form has several times the occurrences of its word, so chains are short and no circle exists.
    """
    steps = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialise(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if steps.where("moved").isEmpty():
            return steps.drop("moved")
        steps = steps.drop("moved")


def spelling_variants(words: DataFrame, ratio: int = RATIO, group_words: int | None = None) -> DataFrame:
    """One row per word of ``words`` (word, n; distinct): (word, form, root, n, n_near, form_n).

    ``form`` is the near word of largest n (of equals the first in code-point order) if that is at least ``ratio`` times the
    word's n, else null, and ``form_n`` its n; ``root`` follows forms to the last, and is the word itself without one.
    """
    words = materialise(words.select("word", "n"), "spelling-words")
    near = near_words(words, group_words)
    joined = words.join(near, "word", "left")
    leads = F.coalesce(F.col("most") >= ratio * F.col("n"), F.lit(False))
    joined = materialise(joined.select("word", F.when(leads, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                       F.when(leads, F.col("most")).alias("form_n")), "spelling-forms")
    led = roots(joined.where(F.col("form").isNotNull()))
    return joined.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
