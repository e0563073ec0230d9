"""Delimited text whose quoted fields hold line breaks, read in many small splits."""

import random

import pytest
from pyspark.sql import types as T

from tessera.sources import text as TX

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])


def written(folder, name, rows, newline="\n", header="id,name,x"):
    body = newline.join([header, *rows]) + newline
    (folder / name).write_bytes(body.encode())


def as_rows(df):
    return sorted(((r.id, r.name, r.x) for r in df.collect()), key=str)


@pytest.fixture
def small_splits(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
    spark.conf.set("spark.sql.files.openCostInBytes", was[1])


def test_quoted_line_breaks(spark, tmp_path, small_splits):
    rng = random.Random(6)
    want = []
    for f in range(3):
        rows = []
        for i in range(80):
            name = "".join(rng.choice(["a", "b", "\n", ",", " ", "é"]) for _ in range(rng.randint(1, 60)))
            name = "n" + name + "n"
            rows.append(f'{i + 100 * f},"{name}",{i}.5')
            want.append((i + 100 * f, name, i + 0.5))
        written(tmp_path, f"f{f}.csv", rows)
    got = TX.read_delimited(spark, str(tmp_path), SCHEMA, multiline=True)
    assert as_rows(got) == sorted(want, key=str)
    # the same as a read that takes each file whole
    whole = spark.read.schema(SCHEMA).option("header", "true").option("multiLine", "true").csv(str(tmp_path))
    assert as_rows(got) == as_rows(whole)
    assert got.where("_corrupt_record is not null").count() == 0


def test_record_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}" for i in range(200))
    written(tmp_path, "a.csv", ["1,short,1.0", f'2,"{long}",2.0', "3,end,3.0"])
    assert as_rows(TX.read_delimited(spark, str(tmp_path), SCHEMA, multiline=True)) == [(1, "short", 1.0), (2, long, 2.0), (3, "end", 3.0)]


def test_bad_rows_are_kept(spark, tmp_path, small_splits):
    written(tmp_path, "a.csv", ["1,ok,1.0", "x,bad,2.0", '3,"two\nlines",oops', "4,short", "", '5,"fine\n",5.0'])
    rows = TX.read_delimited(spark, str(tmp_path), SCHEMA, multiline=True).collect()
    bad = {r._corrupt_record for r in rows if r._corrupt_record is not None}
    assert len(rows) == 5 and bad == {"x,bad,2.0", '3,"two\nlines",oops', "4,short"}
    assert {(r.id, r.name) for r in rows if r._corrupt_record is None} == {(1, "ok"), (5, "fine\n")}


def test_escapes_line_ends_and_headers(spark, tmp_path, small_splits):
    written(tmp_path, "a.csv", ['1,"say ""hi""\r\nthere",1.0', "2,b,2.0"], newline="\r\n", header='id,"na\r\nme",x')
    got = TX.read_delimited(spark, str(tmp_path), SCHEMA, multiline=True, escape='"').collect()
    assert sorted((r.id, r.name, r.x) for r in got) == [(1, 'say "hi"\r\nthere', 1.0), (2, "b", 2.0)]
    other = tmp_path / "other"
    other.mkdir()
    written(other, "b.csv", ['1,"a \\" b\nc",NA'])
    assert [(r.id, r.name, r.x) for r in TX.read_delimited(spark, str(other), SCHEMA, multiline=True).collect()] == [(1, 'a " b\nc', None)]


def test_unclosed_quote_and_no_header(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('1,a,1.0\n2,"open,2.0\n' + "3,c,3.0\n" * 30)
    rows = TX.read_delimited(spark, str(tmp_path), SCHEMA, header=False, multiline=True).collect()
    assert len(rows) == 2 and sorted(r.id for r in rows if r.id is not None)[0] == 1


def test_other_encoding(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes('id;name;x\n1;"Perù\nCittà";1,5\n'.encode("latin-1"))
    got = TX.read_delimited(spark, str(tmp_path), SCHEMA, sep=";", encoding="ISO-8859-1", multiline=True).first()
    assert got.name == "Perù\nCittà"
