"""Small tables that hold what goes wrong: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use inside or return.
CLASHING = ["doc", "class", "registers", "key", "hash", "h", "kept", "component_id", "known", "refs", "redacted", "spans", "rejected",
            "held_out", "ids", "pos", "seed", "item", "found", "words", "lines", "salt", "rule", "turns", "c", "v", "n", "band", "root"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


def messy_rows():
    base = prose(1, 400)
    near = base.split()
    near[200] = "changed"
    long = prose(2, 60_000)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", None), (4, None, None, None), (5, "", "en", "a"),
            (6, " \n\t ", "fr", "b"), (7, "word", "en", "a"), (8, "word", "en", "b"), (8, "word", "en", "b"), (9, long, "en", "b"),
            (10, long + " end", "en", "b"), (None, base, "en", "a"), (None, None, None, "b"), (11, "1234 5678 ...", "en", "a"),
            (12, "a b c d e f g h i j k l m " * 30, "en", "a"), (13, "été 中文 \U0001f600 <|endoftext|> password = hunter2hunter2", None, "a"),
            (14, prose(3, 100) + " " + " ".join(near[50:90]) + " " + prose(4, 100), "en", "a"), (14, prose(3, 100) + " " + " ".join(near[50:90]) + " " + prose(4, 100), "en", "a"),
            (15, "AKIA" + "Q" * 20 + " " + "ab12" * 8, "en", "a"), (16, "x" * 50_000, "en", "a")]
    return [(i, t, la, so, len(t) if t is not None else None) for i, t, la, so in rows]


def messy(spark):
    rows = spark.createDataFrame(messy_rows(), SCHEMA)
    return rows.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
