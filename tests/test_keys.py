"""Keys and references of tables with nulls, repeats and several types."""

from touchline.operators import keys as ky


def test_small_tables(spark):
    a = spark.createDataFrame([(1, "x", 1, 1.5), (2, "x", 2, 1.5), (3, "y", 1, 1.5), (4, "y", 2, None)], "id int, g string, i int, f double")
    b = spark.createDataFrame([(10, 1, None), (11, 1, "x"), (12, 4, "x")], "id long, a_id long, g string")
    none = spark.createDataFrame([], "id int")
    assert ky.unique_keys(a) == [("id",), ("g", "i")]
    assert ky.unique_keys(a, 1) == [("id",)]
    assert ky.unique_keys(b) == [("id",)]
    assert ky.unique_keys(none) == []
    found = {(r.child, r.parent, r.n) for r in ky.references(spark, {"a": a, "b": b, "none": none}).collect()}
    assert found == {("b.a_id", "a.id", 2), ("a.i", "a.id", 2)}
    assert ("b.g", "a.g", 1) in {(r.child, r.parent, r.n) for r in ky.inclusions({"a": a, "b": b}).collect()}


def test_catalogue(spark):
    spark.range(3).createOrReplaceTempView("three_rows")
    got = {r.name: (r.kind, r.columns) for r in ky.catalogue_tables(spark).collect()}
    assert got["three_rows"] == ("TEMPORARY", 1)
    spark.catalog.dropTempView("three_rows")


def test_only_columns_within_bounds_are_grouped(spark):
    wide = spark.range(50).selectExpr("id as k", *[f"id % {i % 20 + 1} as c{i}" for i in range(70)], "cast(id as string) as s", "id + 1000 as far", "timestamp_micros(id) as t")
    narrow = spark.range(20).selectExpr("cast(id as int) as k", "timestamp_micros(id * 2) as t", "cast(null as int) as none", "unhex('ff') as b")
    tables = {"wide": wide, "narrow": narrow}
    got = ky.inclusions(tables, {"wide.k", "narrow.k", "narrow.t", "wide.t", "wide.s"})
    found = {(r.child, r.parent): r.n for r in got.collect()}
    want = {(f"wide.c{i}", parent): i % 20 + 1 for i in range(70) for parent in ("wide.k", "narrow.k")}
    assert found == want | {("narrow.k", "wide.k"): 20, ("narrow.t", "wide.t"): 20}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "bit_or" in plan and "wide.far" not in plan and "wide.s" not in plan
