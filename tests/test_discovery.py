"""Field listings of nested data."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from tracelake.operators import discovery as L

SCHEMA = "id long, who struct<name: string, at: struct<city: string, zips: array<long>>>, items array<struct<kind: string, tags: map<string, double>>>, attributes map<string, string>"
ROWS = [
    Row(1, Row("a", Row("x", [1, None, 3])), [Row("k", {"u": 1.0, "v": None}), Row(None, None), None], {"p": "q"}),
    Row(2, Row(None, None), [], {"p": None, "r": "s"}), Row(3, None, None, None), Row(None, Row("b", Row(None, [])), [Row("z", {})], {}),
]
WANT = {
    ("id", "number", 3, 3), ("who", "struct", 3, 3), ("who.name", "keyword", 2, 2), ("who.at", "struct", 2, 2), ("who.at.city", "keyword", 1, 1), ("who.at.zips", "array", 2, 2), ("who.at.zips[]", "number", 2, 1),
    ("items", "array", 3, 3), ("items[]", "struct", 3, 2), ("items[].kind", "keyword", 2, 2), ("items[].tags", "map", 2, 2), ("items[].tags{}", "number", 1, 1), ("attributes", "map", 3, 3), ("attributes{}", "keyword", 2, 2),
}


def listed(df):
    return {(w.path, w.kind, w["values"], w.rows) for w in L.nested_fields(df).collect() if w.nulls == 4 - w.rows}


def test_three_levels_and_both_formats(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert listed(df) == WANT
    df.write.parquet(str(tmp_path / "p"))
    df.write.option("ignoreNullFields", "false").json(str(tmp_path / "j"))
    assert listed(spark.read.parquet(str(tmp_path / "p"))) == WANT
    assert listed(spark.read.schema(SCHEMA).json(str(tmp_path / "j"))) == WANT
    assert {w.path for w in L.nested_fields(df, "who.*").collect()} == {"who.name", "who.at", "who.at.city", "who.at.zips", "who.at.zips[]"}
    assert L.nested_fields(df, "none").count() == 0


def test_pairs_of_filled_fields(spark):
    df = spark.createDataFrame([(1, "x", {"k": "v", "n": None}), (2, None, {"k": "w"}), (3, "y", None), (None, None, {})], "a long, b string, m map<string, string>")
    got = {(w.a, w.b): w.n for w in L.field_pairs(df).collect()}
    assert got == {("a", "b"): 2, ("a", "m.k"): 2, ("b", "m.k"): 1}
    assert L.field_sets(df.crossJoin(F.broadcast(spark.range(100).select(F.lit(1).alias("one"))))).count() == 4
