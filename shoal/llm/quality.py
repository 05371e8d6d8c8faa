"""Quality rules with thresholds that follow each language and source, with Spark expressions only.

Each rule measures a whole number per document (parts in 10,000, or a count). Its values are
sketched per language and source as a log-linear histogram: a value keeps its six leading bits, so a
bucket is at most 1/32 wide, and two sketches merge by adding counts. Quantiles read from the sketches
give the fences: a document is dropped if a measure lies far above what is usual in its group.
Groups too small to tell take the merged sketch of their language, or of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.session import materialise

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: measure, least distance of the fence above the third quartile
RULES = {"symbol_share": 800, "dup_line_share": 2000, "repeat_share": 2500}
LEADING_BITS = 6
LEAST_ROWS = 100
REACH = 6
SALTS = 64


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of whole texts; null has none.

    Words are runs other than space and 0x09-0x0D. Three-word windows are told apart by a 64-bit hash within their text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(source_col).cast("string").alias("source"), text.alias("text"))
    blank = F.translate("text", "\t\n\x0b\f\r", "     ")
    rows = rows.select("*", F.filter(F.split(blank, " +"), lambda w: w != "").alias("words"),
                       F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"))
    n = F.size("words")
    # (hash of the window, its first word), sorted: equal windows are neighbours
    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    rows = rows.select("*", F.when(n >= 3, F.array_sort(F.transform(
        F.arrays_zip(F.slice("h", 1, n - 2).alias("a"), F.slice("h", 2, n - 2).alias("b"), F.slice("h", 3, n - 2).alias("c")),
        lambda z, i: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("h"), i.alias("i"))))).alias("sorted"))
    m = F.size("sorted")
    again = F.filter(F.transform("sorted", lambda x, i: F.when(
        ((i > 0) & (F.get("sorted", i - 1)["h"] == x["h"])) | ((i < m - 1) & (F.get("sorted", i + 1)["h"] == x["h"])), x["i"])), lambda x: x.isNotNull())
    rows = rows.select("*", F.when(m >= 2, F.array_sort(again)).alias("places"))
    # each window covers three words, or up to the next repeated window
    covered = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, p: F.struct(
        (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")))["n"]
    return rows.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"))


def shares(measured: DataFrame) -> DataFrame:
    """Adds the rules' measures: parts in 10,000, whole."""
    def part(a: str, b: str) -> Column:
        return F.expr(f"CASE WHEN {b} > 0 THEN (10000 * {a}) DIV {b} ELSE 0L END")
    return measured.select("*", part("n_symbols", "word_chars").alias("symbol_share"), part("n_dup_lines", "n_lines").alias("dup_line_share"),
                           part("n_repeat_words", "n_words").alias("repeat_share"))


def bucket(value: Column) -> Column:
    """The smallest value of the bucket: all but the ``LEADING_BITS`` first bits cleared."""
    shift = F.greatest(F.length(F.bin(value)) - LEADING_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(df: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """(groups..., rule, bucket, n): one mergeable histogram per group and rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(F.col(r)).alias("bucket")) for r in names])).alias("x")
    return df.select(*groups, pairs).groupBy(*groups, "x.rule", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "rule", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], percents: dict[str, int]) -> DataFrame:
    """(groups..., rule, rows, name...): for each name the first bucket with at least that percentage of the rows up to it."""
    keys = [*groups, "rule"]
    upto = Window.partitionBy(*keys).orderBy("bucket")
    counted = sketches.withColumn("upto", F.sum("n").over(upto)).withColumn("rows", F.sum("n").over(Window.partitionBy(*keys)))
    return counted.groupBy(*keys).agg(F.max("rows").alias("rows"), *[
        F.min(F.when(100 * F.col("upto") >= p * F.col("rows"), F.col("bucket"))).alias(name) for name, p in percents.items()])


def fences(sketches: DataFrame, rules: dict[str, int], least_rows: int = LEAST_ROWS, reach: int = REACH) -> DataFrame:
    """(lang, source, rule, fence): third quartile plus ``reach`` times the distance of the quartiles, at least the rule's own distance."""
    named = {"q1": 25, "q3": 75}
    own = quantiles(sketches, ["lang", "source"], named)
    by_lang = quantiles(merged(sketches, ["lang"]), ["lang"], named).select(
        "lang", "rule", F.col("rows").alias("rows_l"), F.col("q1").alias("q1_l"), F.col("q3").alias("q3_l"))
    of_all = quantiles(merged(sketches, []), [], named).select("rule", F.col("q1").alias("q1_a"), F.col("q3").alias("q3_a"))
    joined = (own.alias("o").join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.rule") == F.col("l.rule")))
              .join(of_all.alias("a"), F.col("o.rule") == F.col("a.rule")))

    def pick(q: str) -> Column:
        return F.when(F.col("o.rows") >= least_rows, F.col(f"o.{q}")).when(F.col("rows_l") >= least_rows, F.col(f"{q}_l")).otherwise(F.col(f"{q}_a"))
    least = F.create_map(*[x for r, d in rules.items() for x in (F.lit(r), F.lit(d))])
    return joined.select("o.lang", "o.source", "o.rule", (pick("q3") + F.greatest(reach * (pick("q3") - pick("q1")), F.element_at(least, F.col("o.rule")))).alias("fence"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
            rules: dict[str, int] | None = None, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed).

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated three-word
    windows. ``kept`` is false for these and for what lies above a fence of its language and source; ``failed`` names the rules.
    Only rows that pass the base feed the sketches. Null language and null source are groups of their own.
    A null or empty text fails the base. Repeated rows count as often as they stand there.
    """
    rules = rules or RULES
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = materialise(shares(measures(docs, id_col, text_col, lang_col, source_col)).withColumn("base_failed", failed), "measures")
    sketches = materialise(sketch(rows.where(~F.col("base_failed")), ["lang", "source"], list(rules)), "sketches")
    limits = fences(sketches, rules).groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("fence"))).alias(f"fence_{r}") for r in rules])
    # a source may hold a third of all rows: its rows are spread over salts, the fences repeated for each
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    limits = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    key = [salted["salt"] == limits["salt"], *[F.coalesce(salted[c], F.lit("")) == F.coalesce(limits[c], F.lit("")) for c in ("lang", "source")],
           *[salted[c].isNull() == limits[c].isNull() for c in ("lang", "source")]]
    joined = salted.join(limits, key, "left")
    over = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"fence_{r}"), F.lit(r)) for r in rules]))
    over = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(over)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.size(over) == 0)).alias("kept"), F.array_join(over, ",").alias("failed"))
