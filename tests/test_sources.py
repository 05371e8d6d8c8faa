import csv as csv_module
import io
import random

import pytest
from pyspark.sql import functions as F

from shoal.sources.csv import _CSV, _read_records, dataset_files, has_line_breaks, load_csv, load_csv_folder, load_csv_tables
from shoal.sources.results import read_results, write_results


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_inference_and_quotes(spark, tmp_path):
    path = put(tmp_path, "t.csv", 'i,f,b,d,e,na,s\n1,1.5,True,2024-01-02,,NA,x\n'
                                  '2,,False,2024-01-03,,3,"say ""hi"", ok"\n3,NaN,True,2024-01-04,,4,y\n')
    df = load_csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "d": "string", "e": "double",
                               "na": "bigint", "s": "string"}
    rows = df.collect()
    assert rows[1]["s"] == 'say "hi", ok' and rows[2]["f"] is None and rows[0]["na"] is None


def test_lines_inside_quotes(spark, tmp_path):
    path = put(tmp_path, "m.csv", 'a,b\n1,"two\nlines"\n2,plain\n')
    assert has_line_breaks(spark, path)
    assert [r["b"] for r in load_csv(spark, path).collect()] == ["two\nlines", "plain"]
    assert not has_line_breaks(spark, put(tmp_path, "n.csv", 'a,b\n1,"x,y"\n'))


def test_patterns_not_casts(spark, tmp_path):
    path = put(tmp_path, "p.csv", "a,b,c,d\n1d,1e3,99999999999999999999,+5\n2,.5,1,-6\n")
    assert dict(load_csv(spark, path).dtypes) == {"a": "string", "b": "double", "c": "double", "d": "bigint"}


def test_header_names(spark, tmp_path):
    path = put(tmp_path, "h.csv", "a,a,,x.y\n1,2,3,4\n")
    df = load_csv(spark, path)
    assert df.columns == ["a", "a.1", "Unnamed: 2", "x.y"]
    assert tuple(df.first()) == (1, 2, 3, 4)


def test_ragged_rows(spark, tmp_path):
    path = put(tmp_path, "r.csv", "a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception):
        load_csv(spark, path).collect()
    with pytest.raises(Exception):
        load_csv(spark, path).select("a").collect()
    short = load_csv(spark, put(tmp_path, "s.csv", "a,b,c\n1,2,3\n4\n5,6\n"))
    assert sorted(map(tuple, short.collect())) == [(1, 2, 3), (4, None, None), (5, 6, None)]


def test_a_blank_is_a_cell(spark, tmp_path):
    path = put(tmp_path, "b.csv", "a,b\n1, \n2,x\n")
    assert [r["b"] for r in load_csv(spark, path).collect()] == [" ", "x"]


def test_folder_matches_columns_by_name(spark, tmp_path):
    put(tmp_path, "one/t.csv", "a,b\n1,x\n")
    put(tmp_path, "two/t.csv", "b,a\nz,3\n")
    rows = load_csv_tables(spark, str(tmp_path)).select("a", "b").collect()
    assert sorted(map(tuple, rows)) == [(1, "x"), (3, "z")]
    put(tmp_path, "three/t.csv", "a,c\n1,2\n")
    with pytest.raises(ValueError, match="three"):
        load_csv_tables(spark, str(tmp_path))


def test_folder(spark, tmp_path):
    put(tmp_path, "one/t.csv", "a,b\n1,x\n")
    put(tmp_path, "two/t.csv", "a,b\n2,y\n3,z\n")
    put(tmp_path, "two/t.CSV.txt", "a\n9\n")
    assert len(dataset_files(spark, str(tmp_path))) == 2
    tables = load_csv_folder(spark, str(tmp_path))
    assert sorted(df.count() for df in tables.values()) == [1, 2]
    whole = load_csv_tables(spark, str(tmp_path))
    assert whole.select("dataset").distinct().count() == 2 and whole.count() == 3
    with pytest.raises(Exception):
        load_csv_folder(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_results(spark, tmp_path, format):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, " pad ", 1.5)], "k long, s string, x double")
    write_results({"t": df}, str(tmp_path / "run"), format)
    back = read_results(spark, str(tmp_path / "run"), ["t"], format)["t"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception):
        write_results({"t": df}, str(tmp_path / "run"), format)


def test_release_deletes_what_the_application_wrote(spark):
    from shoal.session import materialise, release
    kept = materialise(spark.range(3))
    assert kept.count() == 3 and release(spark) and not release(spark)
    with pytest.raises(Exception):
        kept.select("id").collect()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(text):
    rows = [[c if c else None for c in r] for r in csv_module.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r) or len(r) > 1]
    return rows[0], sorted((tuple(r + [None] * (len(rows[0]) - len(r))) for r in rows[1:]), key=repr)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [37, 200, 1000])
def test_ranges_that_begin_inside_cells(spark, tmp_path, ends, size):
    """Cells span lines and ranges, hold doubled quotes and commas; blank lines, short rows, an open last line."""
    rng = random.Random(size)
    lines = ["name,\"no\"\"te\",x"]
    for i in range(120):
        note = ends.join("".join(rng.choice('ab ,"') for _ in range(rng.randint(0, 30))) for _ in range(rng.choice([1, 1, 2, 3, 9])))
        lines.append(rng.choice([f'r{i},"{note.replace(chr(34), chr(34) * 2)}",t{i}', f"r{i},plain,t{i}", "", f"r{i},short"]))
    text = ends.join(lines)
    put(tmp_path, "wide.csv", text)
    path = str(tmp_path / "wide.csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        names = ["name", 'no"te', "x"]
        found = _read_records(spark, path, names)
        assert found is not None and found.select("__path").distinct().count() == 1
        assert spark.read.text(path).rdd.getNumPartitions() > 2 or size == 1000
        header, want = plain(text.replace("\r\n", "\n"))
        # a quoted empty cell is an empty text, an open one is missing
        assert rows_of(found.select(*[F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")) for n in names])) == want and header == names
        assert rows_of(found.drop("__path")) == rows_of(whole_file(spark, path, names))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def whole_file(spark, path, names):
    schema = ", ".join(f"`{n}` string" for n in [*names, "__more_cells"])
    return spark.read.options(header=True, multiLine=True, **_CSV).schema(schema).csv(path)


def test_files_that_ranges_cannot_read(spark, tmp_path):
    """A quote inside an unquoted cell, lone carriage returns, a header that crosses ranges: one task, the same rows."""
    texts = {"inch.csv": 'a,b\n5" pipe,x\n"two\nlines",y\n', "mac.csv": 'a,b\r1,"two\rlines"\r3,y\r', "head.csv": '"a' + "\n" * 90 + '",b\n1,2\n'}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50)
    try:
        for name, text in texts.items():
            put(tmp_path, name, text)
            names = ["a", "b"]
            assert _read_records(spark, str(tmp_path / name), names) is None
        assert sorted(r["b"] for r in load_csv(spark, str(tmp_path / "inch.csv"), multiline=True).collect()) == ["x", "y"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_folder_of_files_with_breaks(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"d{i}").mkdir()
        put(tmp_path / f"d{i}", "part.csv", "k,v\n" + "".join(f'{i}{j},"line {j}\nnext"\n' for j in range(40)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
    try:
        found = load_csv_tables(spark, str(tmp_path))
        assert found.count() == 120 and found.where("v NOT LIKE '%next'").count() == 0
        assert {r["n"] for r in found.groupBy("dataset").agg(F.count("*").alias("n")).collect()} == {40}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
