"""CSV datasets: one file or a folder tree, with types inferred from the cells."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.columns import col
from shoal.session import materialise

# Cells that mean "missing", the spellings of booleans, and what counts as a number.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = (r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
           r"|^\s*[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])\s*$")


_MORE = "__more_cells"
_CSV = {"quote": '"', "escape": '"', "nullValue": "", "mode": "PERMISSIVE"}


def _read_text(spark: SparkSession, path: str | list[str], multiline: bool, **options) -> DataFrame:
    """All cells as text, and the file's full path as ``__path``. A row with too few cells is padded with NULL, one with
    too many fails the job."""
    reader = spark.read.options(multiLine=multiline, inferSchema=False, **_CSV, **options)
    header = reader.csv(path).first()
    if header is None:
        raise ValueError(f"no header row in {path}")
    names = _header_names(list(header))
    text = T.StringType()
    schema = T.StructType([*[T.StructField(n, text) for n in names], T.StructField(_MORE, text)])
    rows = _read_records(spark, path, names, **options) if multiline else None
    if rows is None:
        rows = reader.option("header", True).schema(schema).csv(path).select("*", F.col("_metadata.file_path").alias("__path"))
    problem = F.concat(F.lit(f"a row has more than {len(names)} cells, the next one holds: "), F.col(_MORE))
    fits = F.when(F.col(_MORE).isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))
    return rows.where(fits)


# A record whose quotes enclose whole cells: then a quote that is not doubled opens or closes a cell.
_WHOLE = re.compile(r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)(?:,(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+))*+')
_PIECES = "path string, start bigint, kind int, text string"
_RECORD, _OPEN, _CLOSING, _INSIDE, _ODD, _HEADER = range(6)


def _odd(text: str) -> bool:
    return '"' in text and not _WHOLE.fullmatch(text)


def _read_records(spark: SparkSession, path: str | list[str], names: list[str], **options) -> DataFrame | None:
    """The rows of files whose cells may span lines, read in byte ranges; None where the quotes do not allow that.

    A first scan counts the quotes of every range. Whether a range starts inside a cell follows from the sum of those
    before it in its file, so tasks put the lines of their range together on their own; a record that crosses ranges is
    joined from its pieces, at most two of a range. Files with a quote inside an unquoted cell, or lines that end with a
    lone carriage return, are left to the reader that takes a file as a whole. Blank records are no rows.
    """
    reader = spark.read.options(lineSep="\n", **options)
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = lines.groupBy("path", "start").agg(F.sum(quotes).alias("n"), F.max(F.col("value").rlike("\r[^\n]")).alias("odd"))
    ranges = materialise(ranges, "csv-ranges")  # one row per range
    if not ranges.where("odd").isEmpty():
        return None
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranges.select("path", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, parity, first, headed = None, [], 0, False, True

        def rows(kinds: list[int], texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(texts), pa.string()), pa.array([at[1]] * len(texts), pa.int64()),
                                               pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], names=["path", "start", "kind", "text"])

        def rest():
            if not headed:  # no whole header where the file begins
                yield rows([_ODD], [""])
            if held:  # the range ends inside a cell
                yield rows([_INSIDE if first else _OPEN], ["\n".join(held)])

        for batch in batches:
            values = pc.replace_substring_regex(batch.column("value"), "\r$", "")  # as the whole-file reader has it, also inside cells
            counts = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
            keys = list(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()))
            borders = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(borders, borders[1:]):
                if keys[a] != at:
                    yield from rest()
                    at, held, first = keys[a], [], bool(batch.column("inside")[a].as_py())
                    parity, headed = int(first), at[1] > 0
                after = (parity + np.cumsum(counts[a:b])) % 2
                parity, texts, begin = int(after[-1]), values.slice(a, b - a).to_pylist(), 0
                kinds, made = [], []
                for end in np.flatnonzero(after == 0).tolist():
                    record = texts[end] if begin == end and not held else "\n".join([*held, *texts[begin:end + 1]])
                    kinds.append(_CLOSING if first else _ODD if _odd(record) else _RECORD if headed or not record.strip() else _HEADER)
                    made.append(record)
                    held, first, begin, headed = [], False, end + 1, headed or kinds[-1] == _HEADER
                held += texts[begin:]
                yield rows(kinds, made)
        yield from rest()

    pieces = lines.join(F.broadcast(inside), ["path", "start"]).select("path", "start", "inside", "value").mapInArrow(assemble, _PIECES)
    # what crosses ranges: a piece that opens a record, and all up to the one that closes it
    crossing = pieces.where(F.col("kind").between(_OPEN, _INSIDE))
    place = F.struct("start", (F.col("kind") == _OPEN).alias("last"))
    record = F.sum((F.col("kind") == _OPEN).cast("int")).over(Window.partitionBy("path").orderBy(place))
    joined = (crossing.withColumn("record", record).groupBy("path", "record")
              .agg(F.array_join(F.sort_array(F.collect_list(F.struct(place.alias("place"), "text")))["text"], "\n").alias("text"), F.min("start").alias("start")))

    def odd_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_odd(t) for t in batch.column(0).to_pylist()], pa.bool_()))

    bad = pieces.where(F.col("kind") == _ODD).select("text").union(joined.select("text").mapInArrow(odd_ones, "text string"))
    if not bad.isEmpty():
        return None
    records = pieces.where(F.col("kind") == _RECORD).select("path", "text").union(joined.select("path", "text"))
    records = records.where(F.trim(F.translate("text", "\n\t", "  ")) != "")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, _MORE])
    cells = F.from_csv("text", schema, _CSV | {"multiLine": "true"})
    return records.select(F.col("path").alias("__path"), cells.alias("c")).select("c.*", "__path")


def _header_names(cells: list[str | None]) -> list[str]:
    """Column names as the header gives them; blank and repeated ones get a suffix."""
    names: list[str] = []
    taken = set()
    for i, cell in enumerate(cells):
        name = base = cell if cell else f"Unnamed: {i}"
        repeat = 0
        while name.lower() in taken:
            repeat += 1
            name = f"{base}.{repeat}"
        taken.add(name.lower())
        names.append(name)
    return names


def has_line_breaks(spark: SparkSession, path: str, **options) -> bool:
    """Whether some quoted cell may span lines: a line then holds an odd number of quotes."""
    reader = spark.read
    for name, value in options.items():
        reader = reader.option(name, value)
    quotes = F.length(F.regexp_replace("value", '[^"]', ""))
    return not reader.text(path).filter(quotes % 2 == 1).isEmpty()


def load_csv(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """Read one CSV dataset with a header row; quotes are doubled, cells may span lines.

    Unless ``multiline`` says whether cells may span lines, a scan over the lines finds out. Such a file is split too: a
    second scan tells of every byte range whether it starts inside a cell. Only a file that has quotes inside unquoted
    cells, or lone carriage returns, is read by one task.
    A row with too few cells is padded with missing ones; one with too many fails the job.
    """
    if multiline is None:
        multiline = has_line_breaks(spark, path)
    return infer_types(_read_text(spark, path, multiline).drop(_MORE, "__path"))


def dataset_files(spark: SparkSession, folder: str) -> list[str]:
    """Full paths of every ``*.csv`` below ``folder`` (extension in lower case)."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
              .option("pathGlobFilter", "*.csv").load(folder).select("path"))
    return sorted(r["path"] for r in listed.collect())


def load_csv_folder(spark: SparkSession, folder: str,
                    multiline: bool | None = None) -> dict[str, DataFrame]:
    """One DataFrame per CSV file of a folder tree, keyed by the file's full path."""
    files = dataset_files(spark, folder)
    if not files:
        raise ValueError(f"no .csv file below {folder}")
    return {path: load_csv(spark, path, multiline) for path in files}


def file_headers(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Column names of every CSV file of a folder tree, from one scan over first lines.

    One line per file reaches the driver. A header that spans lines is refused.
    """
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
             .withColumn("at", F.monotonically_increasing_id()))
    first = lines.where("start = 0").groupBy("path").agg(F.min_by("value", "at").alias("line")).collect()
    found = {}
    for row in first:
        line = row["line"].lstrip("\ufeff")
        if line.count('"') % 2:
            raise ValueError(f"the header of {row['path']} spans lines")
        found[row["path"]] = _header_names(next(csv.reader(io.StringIO(line)), []))
    return found


def load_csv_tables(spark: SparkSession, folder: str, multiline: bool | None = None) -> DataFrame:
    """All CSV files of a folder tree with the same columns as a single table.

    Columns are matched by name: files may order them differently, and each order is read
    apart. A file with other columns is an error. Adds ``dataset``, the full path of the file
    a row came from.
    """
    tree = {"recursiveFileLookup": True, "pathGlobFilter": "*.csv"}
    if multiline is None:
        multiline = has_line_breaks(spark, folder, **tree)
    headers = file_headers(spark, folder)
    if not headers:
        raise ValueError(f"no .csv file below {folder}")
    orders: dict[tuple[str, ...], list[str]] = {}
    for path in sorted(headers):
        orders.setdefault(tuple(headers[path]), []).append(path)
    names = next(iter(orders))
    for order, paths in orders.items():
        if set(order) != set(names):
            raise ValueError(f"{paths[0]} has columns {sorted(order)}, other files have {sorted(names)}")
    text = None
    for paths in orders.values():
        # partition folders in the path are names, not columns
        part = (_read_text(spark, folder, multiline, **tree) if len(orders) == 1
                else _read_text(spark, paths, multiline, recursiveFileLookup=True))
        part = part.select(*[col(n) for n in names], F.col("__path").alias("__dataset"))
        text = part if text is None else text.unionByName(part)
    typed = infer_types(text, list(names))
    return typed.withColumnRenamed("__dataset", "dataset")


def infer_types(text: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Type all-text columns by their cells: BIGINT, DOUBLE, BOOLEAN, else STRING.

    Missing-value tokens become NULL; a column of nothing else is DOUBLE. Dates stay text.
    The kinds of all columns are decided in one aggregate over patterns, not by casting,
    which would accept more than a number.
    """
    cols = text.columns if cols is None else cols
    if not cols:
        return text
    wanted: list[Column] = []
    for i, name in enumerate(cols):
        cell = _present(name)
        wanted += [F.count(cell).alias(f"n{i}"),
                   F.count_if(cell.rlike(INTEGER)).alias(f"int{i}"),
                   F.count_if(cell.rlike(INTEGER) & cell.try_cast("bigint").isNull()).alias(f"wide{i}"),
                   F.count_if(cell.rlike(DECIMAL)).alias(f"dec{i}"),
                   F.count_if(cell.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"bool{i}")]
    seen = text.agg(*wanted).first()
    typed = {}
    for i, name in enumerate(cols):
        cell, n = _present(name), seen[f"n{i}"]
        if n == 0:
            typed[name] = F.lit(None).cast("double")
        elif seen[f"int{i}"] == n and seen[f"wide{i}"] == 0:
            typed[name] = F.trim(cell).try_cast("bigint")
        elif seen[f"dec{i}"] == n:
            typed[name] = F.trim(cell).try_cast("double")
        elif seen[f"bool{i}"] == n:
            typed[name] = cell.isin(*TRUE_TOKENS)
        else:
            typed[name] = cell
    return text.select(*[typed.get(n, col(n)).alias(n) for n in text.columns])


def _present(name: str) -> Column:
    return F.when(~col(name).isin(*NA_TOKENS), col(name))
