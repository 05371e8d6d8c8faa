"""Merkle manifest of a table: one hash tree per source, one over the sources, and a proof for every row.

A node's digest is the hash of its children's digests. The tree is stored as records that lead from a
digest to the digests below it, ``LEVELS`` levels in one record. Requests for proofs descend from the
root through these records by the digits of their ranks and collect the children they do not take; the
path is reversed in the end. Requests that share a prefix of digits travel as one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.session import materialise

FANOUT = 3
LEVELS = 4  #: levels of the tree in one stored record
SPAN = FANOUT ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(digest: Column, path: Column) -> Column:
    """The digest of the root that ``digest`` and its siblings, from the leaf upwards, lead to."""
    return F.aggregate(path, digest, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


@dataclass
class Store:
    """The records of trees. ``records[g]``: (tree, place, size, digest, steps, below, items) of the g-th storey from the
    leaves; ``below[k]`` lists the digests k levels above the record's lowest ones, ``items`` has the leaves and what they
    carry (lowest storey only). ``tops``: (tree, digest, storey) of every tree's root."""

    records: list[DataFrame]
    tops: DataFrame


@dataclass
class Manifest:
    rows: Store  #: one tree per source
    sources: Store  #: the tree over the roots of the sources


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with the rank of each in its ``tree`` by ``order``, and the size of the tree.

    Range partitions are sorted and written with the place of each row; ranks follow from the counts of the earlier
    partitions. A tree of any size is spread over the partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
              .withColumn("part", F.spark_partition_id())
              .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    placed = materialise(placed, "manifest-ranks")
    counts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("tree").alias("t"), F.col("part").alias("p"),
                           (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    joined = placed.join(counts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return joined.withColumn("rank", F.col("at") + F.col("shift")).drop("t", "p", "shift", "part", "at")


def _parents(below: Column) -> Column:
    """The digests of every run of children; the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * FANOUT + 1, FANOUT), ""), 256))


def grow(leaves: DataFrame, order: list[str], carry: tuple[str, ...]) -> Store:
    """Trees over ``leaves`` (tree, digest, the ``order`` and ``carry`` columns)."""
    nodes = ranked(leaves, order)
    most = nodes.agg(F.max("size")).first()[0] or 1
    records, tops = [], []
    while True:
        carried = [F.col(c) for c in carry] if not records else []
        steps = sum(F.when(F.col("size") > FANOUT ** k, 1).otherwise(0) for k in range(LEVELS))
        record = (nodes.groupBy("tree", F.floor(F.col("rank") / SPAN).alias("place"))
                  .agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("rank", "digest", *carried))).alias("items"))
                  .withColumn("steps", steps).withColumn("level0", F.col("items.digest")))
        for k in range(LEVELS):
            below = F.col(f"level{k}")
            record = record.withColumn(f"level{k + 1}", F.when(F.col("steps") > k, _parents(below)).otherwise(below))
        record = record.select("tree", "place", "size", F.col(f"level{LEVELS}")[0].alias("digest"), "steps",
                               F.array(*[f"level{k}" for k in range(LEVELS)]).alias("below"), *(["items"] if not records else []))
        record = materialise(record, "manifest-records")
        tops.append(record.where(F.col("size") <= SPAN).select("tree", "digest", F.lit(len(records)).alias("storey")))
        records.append(record)
        if most <= SPAN:
            break
        most = -(-most // SPAN)
        nodes = record.where(F.col("size") > SPAN).select("tree", F.col("place").alias("rank"), F.ceil(F.col("size") / SPAN).alias("size"), "digest")
    every = tops[0]
    for more in tops[1:]:
        every = every.unionByName(more)
    return Store(records, every)


def _segment(i: Column, steps: Column, below: Column) -> Column:
    """The children not taken on the way from a record's root down to its i-th lowest digest."""
    def level(k):
        at = F.floor(i / FANOUT ** k).cast("int")
        digit = at % FANOUT
        return F.struct(F.array_join(F.slice(below[k], at - digit + 1, digit), "").alias("left"),
                        F.array_join(F.slice(below[k], at + 2, F.lit(FANOUT - 1) - digit), "").alias("right"))
    down = F.array(*[level(k) for k in reversed(range(LEVELS))])
    return F.slice(down, F.lit(LEVELS + 1) - steps, steps)


def descend(store: Store, starts: DataFrame, keep: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    """From the roots in ``starts`` (tree, digest, storey, path, the ``keep`` columns) down to every leaf.

    One row per leaf: tree, digest, the ``carry`` and ``keep`` columns, and the path from the root down.
    """
    columns = ["tree", "place", "digest", "path", *keep]
    front = None
    for g in reversed(range(len(store.records))):
        here = starts.where(F.col("storey") == g).withColumn("place", F.lit(0).cast("long")).select(*columns)
        front = here if front is None else front.unionByName(here)
        record = store.records[g]
        if g:  # equal subtrees share one record
            found = front.join(record.select("digest", "steps", "below").dropDuplicates(["digest"]), "digest")
            children = F.transform(F.col("below")[0], lambda d, i: F.struct(
                d.alias("digest"), i.cast("long").alias("i"), F.concat(F.col("path"), _segment(i, F.col("steps"), F.col("below"))).alias("path")))
            front = (found.select("tree", "place", *keep, F.explode(children).alias("c"))
                     .select("tree", (F.col("place") * SPAN + F.col("c.i")).alias("place"), "c.digest", "c.path", *keep))
    # the lowest records hold rows, so that each place has its own even where digests are equal
    lowest = record.select(F.col("tree").alias("t"), F.col("place").alias("p"), F.col("digest").alias("d"), "steps", "below", "items")
    found = front.join(lowest, (F.col("digest") == F.col("d")) & (F.col("place") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t")))
    rows = F.transform("items", lambda x, i: F.struct(
        x["digest"].alias("digest"), *[x[c].alias(c) for c in carry],
        F.concat(F.col("path"), _segment(i, F.col("steps"), F.col("below"))).alias("path")))
    return found.select("tree", *keep, F.explode(rows).alias("c")).select("tree", *keep, "c.*")


def build_manifest(leaves: DataFrame, carry: tuple[str, ...] = ()) -> Manifest:
    """Trees over ``leaves`` (source, doc_id, leaf and the ``carry`` columns).

    In a source, leaves ascend by doc_id, a null one first, rows of one id by their digest; a null source is the first of
    the sources. Repeated rows are leaves of their own. An empty table has no root. Copies of a whole row share digests,
    so their records are stored once above the lowest storey.
    """
    rows = leaves.select(F.col("source").alias("tree"), F.col("leaf").alias("digest"), "doc_id", *carry).withColumn("u", F.monotonically_increasing_id())
    rows = grow(materialise(rows, "manifest-leaves"), ["doc_id", "digest", "u"], ("doc_id", *carry))
    tops = rows.tops.select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "digest", "storey")
    return Manifest(rows, grow(tops, ["source"], ("source", "storey")))


def prove(manifest: Manifest, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per leaf: doc_id, source, leaf, subroot, root, the ``carry`` columns, and ``path``: the siblings
    (left, right) of every level from the leaf to the root, empty strings where a node has none on that side."""
    starts = manifest.sources.tops.select("tree", "digest", "storey", F.lit(None).cast(PATH).alias("none"), F.col("digest").alias("root"))
    starts = starts.withColumn("path", F.coalesce("none", F.array().cast(PATH))).drop("none")
    sources = descend(manifest.sources, starts, ("root",), ("source", "storey"))
    starts = sources.select(F.col("source").alias("tree"), "digest", "storey", "path", "root", F.col("digest").alias("subroot"))
    rows = descend(manifest.rows, starts, ("root", "subroot"), ("doc_id", *carry))
    return rows.select("doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), "subroot", "root", *carry,
                       F.reverse("path").alias("path"))


def verify(proofs: DataFrame, current: Column) -> DataFrame:
    """``proofs`` with ``folded_root``, to which the digest ``current`` leads, and whether it is the root."""
    folded = proofs.withColumn("folded_root", fold(current, F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_check(docs: DataFrame, tampered: Column, tampered_text: Column, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Build the manifest of ``docs``, then hold each row, its text changed where ``tampered``, against its proof.

    One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Null texts and other
    null fields count as ``-``; further columns are not read, whatever their names.
    """
    values = [F.col(f"`{c}`") for c in fields]
    changed = [tampered_text if c == "text" else F.col(f"`{c}`") for c in fields]
    differs = F.coalesce(tampered & ~tampered_text.eqNullSafe(F.col("text")), F.lit(False))
    leaves = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf(*values).alias("leaf"),
                         F.when(differs, leaf(*changed)).alias("current"))
    proofs = prove(build_manifest(leaves, ("current",)), ("current",))
    checked = verify(proofs, F.coalesce("current", "leaf"))
    return checked.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
