"""Delimited files: types, missing tokens, line ends, round trips."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from fieldsurvey.sources.delimited import compact_schema, parse_col, read_checked, read_codes, read_table, snake, write_table


def text_file(tmp_path, content, name="in.csv"):
    path = tmp_path / name
    path.write_bytes(content.encode())
    return str(path)


def test_compact_specification():
    schema, kept = compact_schema("c-nlDf", ["a", "b", "c", "d", "e", "f"])
    assert kept == ["a", "c", "d", "e", "f"]
    assert [f.dataType.simpleString() for f in schema] == ["string", "string", "double", "boolean", "date", "string"]
    with pytest.raises(ValueError):
        compact_schema("cc", ["a"])
    with pytest.raises(ValueError):
        compact_schema("cx", ["a", "b"])
    assert snake("S.mm_hr0.5") == "s_mm_hr0_5"


def test_positions_types_and_missing_values(spark, tmp_path):
    path = text_file(
        tmp_path,
        "location_ID,skip,time.sec,ok,day,Notes\n"
        "1_0_0,x,\"1,200\",T,2020-07-13,NA\n"
        "1_0_1,y,NA,F,,\"\"\n"
        "\"a,b\",z,3 s,maybe,13.7.20, padded \n",
    )
    df = read_table(spark, path, compact="c-nlDc")
    assert df.columns == ["location_id", "time_sec", "ok", "day", "notes"]
    assert [tuple(r) for r in df.collect()] == [
        ("1_0_0", 1200.0, True, datetime.date(2020, 7, 13), None),
        ("1_0_1", None, False, None, None),
        ("a,b", 3.0, None, None, "padded"),
    ]


def test_skipped_columns_are_not_read(spark, tmp_path):
    path = text_file(tmp_path, "a,b,c\n1,2,3\n")
    plan = read_table(spark, path, compact="n-c")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:string,c:string>" in plan


def test_declared_schema(spark, tmp_path):
    path = text_file(tmp_path, "a,b\n1,x\nbad,\n")
    schema = T.StructType().add("a", "integer").add("b", "string")
    df = read_table(spark, path, schema=schema)
    assert df.schema == schema and [tuple(r) for r in df.collect()] == [(1, "x"), (None, None)]
    with pytest.raises(ValueError):
        read_table(spark, path)
    with pytest.raises(ValueError):
        parse_col("a", T.BinaryType())


@pytest.mark.parametrize("end", ["\r", "\n", "\r\n"])
def test_code_list_line_ends(spark, tmp_path, end):
    path = text_file(tmp_path, end.join(["code,name", "B,bare soil", "F,forb"]) + "\r\n")
    assert [tuple(r) for r in read_codes(spark, path).collect()] == [("B", "bare soil"), ("F", "forb")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, None, 1.5), (1, "", None), (3, "x,y", -2.0)], "a_b int, s string, v double")
    path = str(tmp_path / "out")
    write_table(df, path, ["a_b"], names={"a_b": "A.b"})
    lines = [line.value for line in spark.read.text(path).collect()]
    assert set(lines) == {"A.b,s,v", "1,,NA", "2,NA,1.5", '3,"x,y",-2'}
    back = read_table(spark, path, compact="ncn")
    assert [tuple(r) for r in back.orderBy("a_b").collect()] == [(1.0, None, None), (2.0, None, 1.5), (3.0, "x,y", -2.0)]
    with pytest.raises(Exception):
        write_table(df, path)
    write_table(df, str(tmp_path / "parquet"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3


TEXTS = ['he said "a, b" twice', "path C:\\", 'a "', '""', "x,y", "back\\slash, and \"quote\"", "plain", "NaN"]


def test_quoted_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").coalesce(1)
    write_table(df, str(tmp_path / "out"))
    back = read_table(spark, str(tmp_path / "out"), schema=df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert '"he said ""a, b"" twice"' in next((tmp_path / "out").glob("part-*")).read_text()


def test_line_breaks_inside_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, "two\nlines"), (2, "one")], "id long, t string").coalesce(1)
    write_table(df, str(tmp_path / "out"))
    back = read_table(spark, str(tmp_path / "out"), schema=df.schema, multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("line", ["1", "1,x,5"])
def test_malformed_lines_fail(spark, tmp_path, line):
    path = text_file(tmp_path, f"a,b\n{line}\n")
    schema = T.StructType().add("a", "integer").add("b", "string")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, path, schema=schema).collect()
    assert read_table(spark, path, schema=schema, lenient=True).first().a == 1


def test_whole_numbers_have_no_point(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 0.5), (-3.0, None), (1e20, 2.0)], "a double, b double").coalesce(1)
    write_table(df, str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("part-*")).read_text().split() == ["a,b", "1,0.5", "-3,NA", "1.0E20,2"]


def test_floats_and_decimals_without_needless_digits(spark, tmp_path):
    rows = [(1.0, Decimal("2.00"), Decimal(7)), (0.5, Decimal("10.50"), Decimal(100)), (-3.0, Decimal("-0.05"), None), (1e9, Decimal("100.00"), Decimal(0))]
    df = spark.createDataFrame(rows, "a float, b decimal(9,2), c decimal(5,0)").coalesce(1)
    write_table(df, str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("part-*")).read_text().split() == ["a,b,c", "1,2,7", "0.5,10.5,100", "-3,-0.05,NA", "1.0E9,100,0"]


def folder(tmp_path, **files):
    (tmp_path / "many").mkdir()
    for name, content in files.items():
        text_file(tmp_path / "many", content, f"{name}.csv")
    return str(tmp_path / "many")


def test_columns_by_the_header_of_each_file(spark, tmp_path):
    path = folder(
        tmp_path, a='Key,x.m,"note, long"\nk1,1,n1\n', b='note, long\n', c='"note, long", Key,x.m\n"n,2",k2,2\nn3,k3,3\n', d='Key,x.m,"note, long"\n'
    )
    # A header that does not have the columns names its file.
    with pytest.raises(ValueError, match="b.csv"):
        read_table(spark, path, compact="cnc", by_name=True)
    files = [f"{path}/{n}.csv" for n in "acd"]
    for options in ({"compact": "cnc"}, {"compact": "ccn", "names": ["key", "note, long", "x_m"]}):
        df = read_table(spark, files, by_name=True, **options)
        assert sorted(map(tuple, df.select("key", "x_m", "note, long").collect())) == [("k1", 1.0, "n1"), ("k2", 2.0, "n,2"), ("k3", 3.0, "n3")]
    schema = T.StructType().add("x_m", "integer").add("key", "string").add("note, long", "string")
    df = read_table(spark, files, schema=schema, by_name=True)
    assert df.schema == schema and sorted(r.x_m for r in df.collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="a.csv"):
        read_table(spark, files, schema=schema.add("other", "string"), by_name=True)


def test_first_lines_are_read_without_the_rest(spark, tmp_path):
    """One task a file, whatever its size; a folder without files has no header."""
    from fieldsurvey.sources.delimited import file_headers

    path = folder(tmp_path, a="h1,h2\n" + "1,2\n" * 400_000, b="h1,h2\n", c="")
    found = file_headers(spark, path)
    assert sorted((r.file[-5:], r.line) for r in found.collect()) == [("a.csv", "h1,h2"), ("b.csv", "h1,h2")]
    assert found.rdd.getNumPartitions() == 2
    (tmp_path / "none").mkdir()
    schema = T.StructType().add("a", "string")
    assert read_table(spark, str(tmp_path / "none"), schema=schema, by_name=True).count() == 0


def test_bad_lines_are_kept_apart(spark, tmp_path):
    lines = ["a,b,c,d", "1,x,2020-01-02,T", "2,y", '3,"z, ""q""",2020-01-03,F', "4,x,2020-01-04,T,more", 'five,"w",13.7.20,NA', '6,"open,2020-01-05,T', ",,,"]
    path = text_file(tmp_path, "\n".join(lines) + "\n")
    checked = read_checked(spark, path, compact="ncDl")
    assert sorted(map(repr, (tuple(r) for r in checked.rows.collect()))) == sorted(map(repr, [
        (1.0, "x", datetime.date(2020, 1, 2), True), (3.0, 'z, "q"', datetime.date(2020, 1, 3), False),
        (None, "w", None, None), (None, None, None, None),
    ]))
    problems = {(r.column, r.text, r.reason) for r in checked.problems.collect()}
    assert problems == {
        (None, "2,y", "4 fields expected, 2 found"), (None, lines[4], "4 fields expected, 5 found"), (None, lines[6], "quote left open"),
        ("a", "five", "not a number"), ("c", "13.7.20", "not a date"),
    }
    assert {r.file[-6:] for r in checked.problems.collect()} == {"in.csv"}
    # Text columns alone, and all columns skipped but one.
    text = read_checked(spark, path, schema=T.StructType().add("a", "string").add("b", "string").add("c", "string").add("d", "string"))
    assert text.problems.count() == 3 and text.rows.count() == 4
    assert read_checked(spark, path, compact="n---").problems.count() == 4
