import os

from colorway.sources import io


def test_versioned_snapshots(spark, scratch):
    base = os.path.join(scratch, "snap")
    assert io.read_snapshot(spark, base) is None
    io.write_snapshot(spark.createDataFrame([(1, "a")], "k long, v string"), base, 0)
    io.write_snapshot(spark.createDataFrame([(2, "b")], "k long, v string"), base, 1)
    # A folder without a commit marker is not a version.
    os.makedirs(os.path.join(base, io.version_path("", 7).lstrip("/")))
    assert io.committed_versions(spark, base) == [0, 1]
    assert [r["k"] for r in io.read_snapshot(spark, base).collect()] == [2]
    assert [r["k"] for r in io.read_snapshot(spark, base, before=1).collect()] == [1]
    # A rerun of a version overwrites only that version.
    io.write_snapshot(spark.createDataFrame([(3, "c")], "k long, v string"), base, 1)
    assert [r["k"] for r in io.read_snapshot(spark, base).collect()] == [3]
    assert [r["k"] for r in io.read_snapshot(spark, base, version=0).collect()] == [1]


def test_partitioned_snapshot_round_trip(spark, scratch):
    base = os.path.join(scratch, "cat")
    df = spark.createDataFrame([(1, "jeans"), (2, None), (3, "007")], "id long, category_slug string")
    io.write_snapshot(df, base, 0, partition_by=["category_slug"])
    back = io.read_snapshot(spark, base, schema=df.schema)
    assert sorted((r["id"], r["category_slug"]) for r in back.collect()) == [(1, "jeans"), (2, None), (3, "007")]


def test_scan_table_and_append(spark, scratch):
    from colorway.sources.schemas import SCHEMAS
    d = os.path.join(scratch, "tables")
    rows = spark.createDataFrame([(1, "XS", 1)], "x long, label string, sort_order int").drop("x")
    for batch in ("a", "b", "b"):  # a rerun of a batch adds nothing
        io.append_rows(rows, os.path.join(d, "sizes"), batch)
    got = io.read_appended(spark, os.path.join(d, "sizes"), SCHEMAS["sizes"])
    assert got.schema == SCHEMAS["sizes"] and got.count() == 2
    assert io.scan_table(spark, d, "sizes").select("label").count() == 2


def test_tables_of_two_folders_and_later_files(spark, scratch):
    """Each ``Tables`` lists its own folder once; a later one sees new files."""
    from colorway.sources.fixtures import load_tables
    small, large = load_tables(spark, "/root/testdata/sf0.001"), load_tables(spark, "/root/testdata/sf0.01")
    a, b = small["users"], large["users"]
    assert a.count() < b.count() and small["users"].count() == a.count()
    assert small.base("lineitem") is small.base("lineitem")
    path = f"{scratch}/sf"
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    customers.limit(3).write.parquet(f"{path}/customer.parquet")
    first = load_tables(spark, path)
    assert first["users"].count() == 3
    customers.limit(2).write.mode("append").parquet(f"{path}/customer.parquet")
    assert load_tables(spark, path)["users"].count() == 5
    assert not [t for t in spark.catalog.listTables() if t.name in ("customer", "lineitem")]
