"""What fields a signal has, how they are filled, and which go together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += leaves(f.dataType, f"{name}.") if isinstance(f.dataType, T.StructType) else [(name, f.dataType)]
    return out


def _kind(t: T.DataType) -> str:
    return "number" if isinstance(t, _NUMERIC) else "date" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "boolean" if isinstance(t, T.BooleanType) else "keyword" if isinstance(t, T.StringType) else "object"


def _role(name: str) -> str:
    low = name.lower()
    for role, words in (("trace", ("trace_id", "traceid")), ("span", ("span_id", "spanid")), ("level", ("level", "severity")), ("message", ("message", "body")), ("duration", ("duration",)), ("status", ("status", "error")), ("service", ("service",))):
        if any(w in low for w in words):
            return role
    return "other"


def list_fields(df: DataFrame, pattern: str = "*") -> DataFrame:
    """Name, type group, role and non-null count of each leaf column that fits the pattern: one pass."""
    import fnmatch

    found = [(n, t) for n, t in leaves(df.schema) if fnmatch.fnmatchcase(n, pattern)]
    one = df.agg(*[F.count(F.col(n)).alias(str(i)) for i, (n, _) in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(_kind(t)).alias("type"), F.lit(_role(n)).alias("role"), F.col(f"`{i}`").alias("n")) for i, (n, t) in enumerate(found)])
    return one.select(F.explode(rows).alias("f")).select("f.*")


def map_fields(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    return df.select(F.explode(F.map_keys(attributes)).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def service_fields(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    return df.select("service", F.explode(F.map_keys(attributes)).alias("field")).groupBy("service", "field").agg(F.count("*").alias("n"))


def json_fields(df: DataFrame, column: str) -> DataFrame:
    """Top-level keys of a JSON text column."""
    return df.select(F.explode(F.json_object_keys(column)).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def _map_names(name: str) -> Column:
    keys = F.map_keys(F.map_filter(F.col(name), lambda _, v: v.isNotNull()))
    return F.transform(keys, lambda k: F.concat(F.lit(f"{name}."), k.cast("string")))


def _members(structs: Column, name: str) -> Column:
    return F.transform(structs, lambda v: v.getField(name))


def filled(df: DataFrame, fields: Sequence[str] | None = None) -> Column:
    """The names of a row's filled leaves, sorted: the given fields, or all leaf columns and the keys of map columns with a value."""
    wanted = [(n, t) for n, t in leaves(df.schema) if fields is None or n in fields]
    plain = [n for n, t in wanted if not isinstance(t, T.MapType)]
    there = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in plain])) if plain else F.array().cast("array<string>")
    maps = [_map_names(n) for n, t in wanted if isinstance(t, T.MapType)]
    return F.array_sort(F.concat(there, *[F.coalesce(m, F.array().cast("array<string>")) for m in maps]))


def field_sets(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """fields, n: the distinct sets of filled fields, few however many rows there are."""
    return df.select(filled(df, fields).alias("fields")).groupBy("fields").agg(F.count("*").alias("n"))


def field_pairs(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """a < b, n: how often two fields are filled in the same row. Rows with the same fields are counted before pairs are made."""
    a = field_sets(df, fields).select(F.explode("fields").alias("a"), "fields", "n").select("a", F.explode("fields").alias("b"), "n")
    return a.filter("a < b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _walk(values: Column, kind: T.DataType, path: str) -> list[tuple[str, str, Column]]:
    """(path, kind, the row's number of values that are there) of every node, from an array of the values of one."""
    there = F.filter(values, lambda v: v.isNotNull())
    n = F.size(there)
    if isinstance(kind, T.StructType):
        found = [(path, "struct", n)] if path else []
        for f in kind.fields:
            found += _walk(_members(there, f.name), f.dataType, f"{path}.{f.name}" if path else f.name)
        return found
    if isinstance(kind, T.ArrayType):
        return [(path, "array", n), *_walk(F.flatten(there), kind.elementType, f"{path}[]")]
    if isinstance(kind, T.MapType):
        return [(path, "map", n), *_walk(F.flatten(F.transform(there, F.map_values)), kind.valueType, f"{path}{{}}")]
    return [(path, _kind(kind), n)]


def nested_fields(df: DataFrame, pattern: str = "*") -> DataFrame:
    """path, kind, role, values, rows, nulls of every node of structs, arrays (``a[]``) and maps (``m{}``): one aggregate, whatever the nesting.

    ``rows`` have at least one value, ``nulls`` none.
    """
    import fnmatch

    nodes = []
    for f in df.schema.fields:
        nodes += _walk(F.array(F.col(f"`{f.name}`")), f.dataType, f.name)
    nodes = [x for x in nodes if fnmatch.fnmatchcase(x[0], pattern.replace("[", "[[]"))]
    if not nodes:
        return df.sparkSession.createDataFrame([], "path string, kind string, role string, values long, rows long, nulls long")
    counts = df.select(*[n.alias(str(i)) for i, (_, _, n) in enumerate(nodes)])
    one = counts.agg(F.count("*").alias("all"), *[F.coalesce(F.sum(f"`{i}`"), F.lit(0)).alias(f"v{i}") for i in range(len(nodes))], *[F.count_if(F.col(f"`{i}`") > 0).alias(f"r{i}") for i in range(len(nodes))])
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind"), F.lit(_role(p)).alias("role"), F.col(f"v{i}").cast("long").alias("values"), F.col(f"r{i}").alias("rows"), (F.col("all") - F.col(f"r{i}")).alias("nulls")) for i, (p, k, _) in enumerate(nodes)])
    return one.select(F.explode(rows).alias("f")).select("f.*")


def field_profile(df: DataFrame, fields: Sequence[str], exact: bool = False) -> DataFrame:
    """Distinct values and nulls of each field; high cardinality above 1000, good for grouping from 2 to 99."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    one = df.agg(*[distinct(F.col(f)).alias(f"d{i}") for i, f in enumerate(fields)], *[F.count_if(F.col(f).isNull()).alias(f"n{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f"d{i}").alias("distinct"), F.col(f"n{i}").alias("nulls")) for i, f in enumerate(fields)])
    out = one.select(F.explode(rows).alias("f")).select("f.*")
    return out.withColumn("high_cardinality", F.col("distinct") > 1000).withColumn("good_for_grouping", F.col("distinct").between(2, 99))


def metric_paths(df: DataFrame, skip: Sequence[str] = ("_id", "trace_id", "span_id")) -> list[str]:
    """Numeric leaf columns."""
    return [n for n, t in leaves(df.schema) if isinstance(t, _NUMERIC) and n not in skip]
