"""Bundles: proven restores, found changes; and the sinks and readers beside them."""

import os

import pytest
from pyspark.sql import functions as F

from larkspur.sources import bundle, io

SF = "/root/testdata/sf0.001"


def test_a_bundle_is_restored_as_it_was(spark, tmp_path):
    tables = {n: spark.read.parquet(f"{SF}/{n}.parquet").repartition(3) for n in ("nation", "customer")}
    folder = str(tmp_path / "bundle")
    bundle.write_bundle(tables, folder)
    assert bundle.problems(spark, folder).count() == 0
    for name, df in tables.items():
        back = bundle.restored(spark, folder, name)
        assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    narrow = tables["customer"].select(F.col("c_custkey").cast("string"), F.lit("x").alias("own"), "c_name").limit(2)
    found = bundle.restored(spark, folder, "customer", narrow)
    assert found.columns == ["c_custkey", "c_name"] and dict(found.dtypes)["c_custkey"] == "string"
    both = bundle.copy_into(narrow, tables["customer"])
    assert both.columns == narrow.columns and both.where("own IS NULL").count() == tables["customer"].count()


def test_a_changed_byte_a_lost_and_an_added_file_are_found(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/customer.parquet").repartition(4)
    folder = tmp_path / "bundle"
    bundle.write_bundle({"customer": df, "nation": df.limit(5)}, str(folder))
    files = sorted((folder / "customer").glob("*.parquet"))
    data = bytearray(files[0].read_bytes())
    data[len(data) // 2] ^= 1
    files[0].write_bytes(data)
    for f in (folder / "customer").glob(f".{files[0].name}.crc"):
        f.unlink()
    (folder / "customer" / "more.parquet").write_bytes(files[2].read_bytes())
    os.remove(files[1])
    found = {(r["path"].rsplit("/", 1)[-1], r["problem"]) for r in bundle.problems(spark, str(folder)).collect()}
    assert found == {(files[0].name, "changed"), ("more.parquet", "unexpected"), (files[1].name, "missing")}
    with pytest.raises(ValueError, match="customer"):
        bundle.restored(spark, str(folder), "customer")
    assert bundle.restored(spark, str(folder), "nation").count() == 5


def test_lines_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "é\n"), (3, "b", "")], "id int, kind string, text string")
    io.write_lines(df, str(tmp_path / "lines"))
    back = io.read_json(spark, str(tmp_path / "lines"), "id int, kind string, text string, more string")
    assert sorted(map(tuple, back.collect())) == [(1, "a", None, None), (2, "b", "é\n", None), (3, "b", "", None)]
    (tmp_path / "seed.json").write_text('[\n{"id": 7, "kind": "s"},\n{"id": 8}\n]')
    assert sorted(map(tuple, io.read_json(spark, str(tmp_path / "seed.json"), "id int, kind string", lines=False).collect())) == [(7, "s"), (8, None)]
    path = str(tmp_path / "table")
    io.replace_partitions(df, path, "kind")
    io.replace_partitions(spark.createDataFrame([(9, "b", "new")], df.schema), path, "kind")
    assert sorted((r["id"], r["kind"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]
