"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

A document's set holds its distinct shingles of five words (A-Z folded). Its sketch has 128
registers: a shingle's hash picks the register, and the smallest of the rest is kept as its count
of leading zeros and ten bits of mantissa, 16 bits in all. Bands of four registers select
candidates, the collision-corrected estimate drops hopeless ones, and the full sets decide.

Documents with equal sets form one class first, so that thousands of copies cost one node. Inside
a band key every member is compared with the smallest; what that leaves in different components
is then compared block by block, sketches first and full sets after, and only links that join
something new come out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.bitmap import bitmap, holds
from shoal.llm.components import components
from shoal.llm.words import WordHasher, mix, numbers, row_numbers, slices, windows
from shoal.session import materialise

REGISTERS, BAND, MANTISSA = 128, 4, 10
EMPTY = 0xFFFF
#: Standard error of the estimate at J = 0.8 is 0.035; a pair is dropped unseen only this far below.
MARGIN = 0.25
BLOCK = 1024


def shingle_sets(column: pa.Array, hasher: WordHasher, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text, offsets). A shorter text is one shingle of all its words."""
    hashes, starts = hasher(column)
    shingles, inside = windows(hashes, starts, k)
    sizes = np.diff(starts)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    place = starts[:-1][short]
    whole = np.zeros(len(short), np.uint64)
    constants = numbers(99, k)
    for j in range(k - 1):
        more = sizes[short] > j
        whole[more] += hashes[place[more] + j] * constants[j]
    shingles[place] = mix(whole + sizes[short].astype(np.uint64) * constants[k - 1])
    inside[place] = True
    doc = row_numbers(starts)[inside]
    shingles = shingles[inside]
    order = np.lexsort((shingles, doc))
    doc, shingles = doc[order], shingles[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])
    return shingles[fresh], np.searchsorted(doc[fresh], np.arange(len(starts)))


def _probes() -> np.ndarray:
    """For each register, the order in which an empty one asks the others for a value."""
    draws = numbers(5, REGISTERS * REGISTERS).reshape(REGISTERS, REGISTERS)
    return np.argsort(draws, axis=1).astype(np.uint8)


def registers(sets: np.ndarray, starts: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """(texts x 128) registers: leading zeros above ``MANTISSA`` bits; texts without shingles have ``EMPTY`` ones."""
    n = len(starts) - 1
    best = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    place = row_numbers(starts) * REGISTERS + (sets & np.uint64(REGISTERS - 1)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    if len(order):
        sorted_place = place[order]
        heads = np.flatnonzero(np.concatenate(([True], sorted_place[1:] != sorted_place[:-1])))
        best[sorted_place[heads]] = np.minimum.reduceat((sets >> np.uint64(7))[order], heads)
    filled = best != np.iinfo(np.uint64).max
    value = np.maximum(best, np.uint64(1))
    bits = np.floor(np.log2(value.astype(np.float64))).astype(np.int64)  # a 57-bit number's leading one
    bits -= (value >> np.clip(bits, 0, 63).astype(np.uint64)) == 0
    zeros = np.clip(56 - bits, 0, 60)
    low = np.where(bits >= MANTISSA, value >> np.clip(bits - MANTISSA, 0, 63).astype(np.uint64),
                   value << np.clip(MANTISSA - bits, 0, 63).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out = np.where(filled, (zeros << MANTISSA) | low.astype(np.int64), EMPTY).astype(np.uint16).reshape(n, REGISTERS)
    filled = filled.reshape(n, REGISTERS)
    for row in np.flatnonzero(~filled.all(axis=1) & filled.any(axis=1)):
        have = filled[row][probes]  # register x order of asking
        giver = probes[np.arange(REGISTERS), have.argmax(axis=1)]
        out[row] = np.where(filled[row], out[row], out[row][giver])
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of ``n`` and ``m`` shingles agree."""
    a, b = n / REGISTERS, m / REGISTERS
    cell = 2.0 ** -np.arange(1, 58)
    terms = cell ** 2 * np.exp(-1.5 * (a + b)[..., None] * cell)
    return np.minimum(0.99, 2.0 ** -MANTISSA * a * b * terms.sum(axis=-1))


def corrected(same: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less those equal by chance."""
    by_chance = chance(n.astype(float), m.astype(float))
    return (same - by_chance) / (1 - by_chance)


def estimate(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return corrected((left == right).mean(axis=-1), n, m)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(doc, text_hash, n_shingles, class, registers): class is a digest of the set, null where it is empty."""
    def run(batches):
        hasher, probes = WordHasher(fold=True), _probes()
        for part in slices(batches, "text"):
            sets, starts = shingle_sets(part.column("text"), hasher, k)
            made = registers(sets, starts, probes)
            raw = sets.astype("<u8").tobytes()
            classes = [hashlib.md5(raw[8 * a:8 * b]).digest() if b > a else None for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("text_hash"), pa.array(np.diff(starts)), pa.array(classes, pa.binary()),
                 pa.array([r.tobytes() for r in made], pa.binary())], ["doc", "text_hash", "n_shingles", "class", "registers"])
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc long, text_hash long, n_shingles long, class binary, registers binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(key, band, node) for each band of each node."""
    def run(batches):
        constants = numbers(31, BAND)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                made = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                groups = made.reshape(len(made), REGISTERS // BAND, BAND).astype(np.uint64)
                keys = mix((groups * constants).sum(axis=2, dtype=np.uint64)
                           + np.arange(REGISTERS // BAND, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C55))
                rows = np.repeat(np.arange(len(made)), REGISTERS // BAND)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(REGISTERS // BAND, dtype=np.int32), len(made))),
                     part.column("node").take(pa.array(rows))], ["key", "band", "node"])
    return nodes.select("node", "registers").mapInArrow(run, "key long, band int, node long")


def _may_link(same: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles with that share of equal registers may reach the threshold; small sets always may."""
    near = corrected(same, n, m) >= percent / 100 - MARGIN
    return (near | (np.minimum(n, m) < 64)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _hopeful(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose estimate may reach the threshold."""
    def side(name):
        return nodes.select(F.col("node").alias(name), F.col("registers").alias(f"{name}_r"), F.col("n_shingles").alias(f"{name}_n"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                left, right = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("a_r", "b_r"))
                keep = _may_link((left == right).mean(axis=1), part.column("a_n").to_numpy(), part.column("b_n").to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_r", "b_r", "a_n", "b_n")
            .mapInArrow(run, "a long, b long"))


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, shingles): the whole sets of the ``wanted`` nodes (node, class, doc, text_hash), from one more scan of the texts.

    A node's set is read from the rows of its doc_id, or, where no copy has one, from those of its text; a task passes
    each set on once, however many rows of one text it meets."""
    def place(doc, text_hash):
        return F.when(doc.isNull(), text_hash).otherwise(F.xxhash64(doc))
    wanted = wanted.select("node", "class", place(F.col("doc"), F.col("text_hash")).alias("h"))
    bits = bitmap(wanted, F.col("h"))

    def sets(batches):
        hasher, passed = WordHasher(fold=True), set()
        for part in slices(batches, "text"):
            part = part.filter(pa.array(holds(bits, part.column("h").to_numpy().view(np.uint64))))
            if not part.num_rows:
                continue
            found, starts = shingle_sets(part.column("text"), hasher, k)
            raw = found.astype("<u8").tobytes()
            rows = [raw[8 * a:8 * b] for a, b in zip(starts, starts[1:])]
            classes = [hashlib.md5(r).digest() for r in rows]
            seen = list(zip(classes, part.column("h").to_pylist(), part.column("known").to_pylist()))
            fresh = [s[2] or not (s in passed or passed.add(s)) for s in seen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.binary()), part.column("h"), pa.array(rows, pa.binary())], ["class", "h", "shingles"]).filter(pa.array(fresh))
    doc, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(place(doc, F.xxhash64(text)).alias("h"), doc.isNotNull().alias("known"), text.alias("text"))
    full = rows.mapInArrow(sets, "class binary, h long, shingles binary").join(wanted, ["class", "h"])
    return full.groupBy("node").agg(F.first("shingles").alias("shingles"))  # a repeated row has the same set


def _shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of the sorted set ``x`` with each of the others."""
    sizes = np.array([len(y) for y in others])
    flat = np.concatenate(others)
    place = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    return np.add.reduceat((x[place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int(_shared(x, [y])[0])
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    x = full.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = full.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _rest(shared: DataFrame, roots: DataFrame, nodes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside the band keys that the stars left in several components.

    A key with many members is cut into blocks, and each pair of blocks is a task's unit of work. The
    task looks at a pair in the first of its common bands only, confirms it on the full sets, and reports
    no link between what it has already joined: at most one per member, however many pairs there are.
    """
    labelled = shared.join(roots, shared["node"] == roots["of"], "left").select("key", "band", "node", "a", F.coalesce("root", "node").alias("root"))
    open_keys = (labelled.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
                 .where((F.col("m") > 2) & (F.col("lo") != F.col("hi"))))
    members = labelled.join(open_keys.select("key", "m"), "key").where(F.col("node") != F.col("a"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = (members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .join(nodes.select("node", "registers", "n_shingles"), "node").join(full, "node")
               .select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                       "block", "node", "root", "registers", "n_shingles", "shingles"))

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        band = table.column("band")[0].as_py()
        block, node, n = (table.column(c).to_numpy() for c in ("block", "node", "n_shingles"))
        made = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        root = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
        rights, out = np.flatnonzero(block == j), []
        for x in np.flatnonzero(block == i):
            ys = rights[root[rights] != root[x]]
            ys = ys[ys > x] if i == j else ys
            if not len(ys):
                continue
            same = made[ys] == made[x]
            first = same.reshape(len(ys), -1, BAND).all(axis=2).argmax(axis=1) == band
            ys = ys[first & _may_link(same.mean(axis=1), n[ys], np.full(len(ys), n[x]), percent)]
            if not len(ys):
                continue
            both = _shared(sets[x], [sets[y] for y in ys])
            for y in ys[100 * both >= percent * (n[ys] + n[x] - both)]:
                if root[y] != root[x]:
                    root[root == root[y]] = root[x]
                    out.append((node[x], node[y]))
        return pa.table({"a": pa.array([int(p[0]) for p in out], pa.int64()), "b": pa.array([int(p[1]) for p in out], pa.int64())})
    return members.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept, text_hash).

    Documents are linked if their sets of ``k``-word shingles have 100 * intersection >= percent * union.
    ``component_id`` is the smallest doc_id reachable, ``kept`` marks it. Null or wordless texts have
    no shingles and are their own component. A null doc_id never lends its id: such a row takes the
    component's id if others, directly or through rows without id, are linked with it, else null, and is kept only then. Repeated rows
    (same doc_id) share a component and all say kept. Other columns of ``docs`` are not read; ``text_hash``
    (xxhash64 of the text) tells apart rows whose doc_id is null or stands for several texts.

    Misses: a pair at 0.80 shares none of the 32 bands with probability 5e-8, one at 0.85 with 6e-11.
    """
    made = materialise(sketches(docs, id_col, text_col, k), "sketches")
    nodes = materialise(made.where(F.col("class").isNotNull()).groupBy("class").agg(  # numbered once, in the written table
        F.min("doc").alias("doc"), F.min("text_hash").alias("text_hash"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n_shingles"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = _bands(nodes)
    centres = bands.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("m")).where("m > 1").select("key", "a")
    shared = materialise(bands.join(centres, "key"), "bands")
    stars = shared.where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    pairs = materialise(_hopeful(stars, nodes, percent), "pairs")
    full = materialise(_full_sets(docs, nodes.join(shared.select("node").distinct(), "node"), id_col, text_col, k), "sets")
    links = materialise(_confirmed(pairs, full, percent), "links")
    roots = components(links).withColumnRenamed("node", "of")
    more = _rest(shared, roots, nodes, full, percent)
    roots = components(links.union(more)).withColumnRenamed("node", "of")
    labelled = nodes.join(roots, F.col("node") == F.col("of"), "left").select(
        "class", "doc", F.coalesce("root", "node").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("doc").alias("component_id"))
    of_class = labelled.join(smallest, "root").select("class", "component_id")
    columns = ["doc", "text_hash", "n_shingles", "component_id"]
    linked = made.where(F.col("class").isNotNull()).join(of_class, "class", "left").select(*columns)
    alone = made.where(F.col("class").isNull()).withColumn("component_id", F.col("doc")).select(*columns)
    return linked.union(alone).select(
        F.col("doc").alias("doc_id"), "n_shingles", "component_id",
        F.coalesce(F.col("doc") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "text_hash")
