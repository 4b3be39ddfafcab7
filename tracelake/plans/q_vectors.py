"""Embedding, search, clustering and discovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions.stats import cosine
from tracelake.operators import discovery as L
from tracelake.operators import logtext as T
from tracelake.operators import spans as N
from tracelake.operators import vectors as V
from tracelake.plans.fixtures import LOGS, SPANS, logs, spans, table
from tracelake.plans.registry import query


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


_HASHED = """w AS (SELECT id, unnest(string_split(lower(text), ' ')) AS w FROM texts), c AS (SELECT id, unnest(string_split(w, '')) AS ch, unnest(range(1, length(w) + 1)) AS p FROM w WHERE w <> ''), v AS (SELECT id, (unicode(ch) * p) % 384 AS i, count(*) AS n FROM c GROUP BY ALL)"""


@query("e1_hash_embedding", f"""WITH {LOGS}, texts AS (SELECT event_id AS id, message AS text FROM logs), {_HASHED}, m AS (SELECT id, i, n, min(n) OVER (PARTITION BY id) AS least FROM v)
SELECT id AS event_id, 384 AS dim, string_agg(concat(i, ':', CAST(n * 1000 // least AS BIGINT)), ' ' ORDER BY i) AS weights FROM m GROUP BY id""")
def _(spark, sf):
    """The filled places of each vector and their weights in thousandths of the least one."""
    from tracelake.shipping import ship

    ship(spark)
    e = logs(spark, sf).select("event_id", V.hash_embed(F.col("message")).alias("e"))
    least = F.array(F.array_min(F.filter("e", lambda x: x > 0)))  # bound once a row, not once a place
    weights = lambda m: F.transform("e", lambda x, i: F.when(x > 0, F.concat_ws(":", i, F.floor(x / m * 1000 + 0.01).cast("long"))))
    place = F.filter(F.get(F.transform(least, weights), F.lit(0)), lambda x: x.isNotNull())
    return e.select("event_id", F.size("e").alias("dim"), F.array_join(place, " ").alias("weights"))


def _searched(words: str, k: int) -> str:
    return f"""{LOGS}, texts AS (SELECT event_id AS id, message AS text FROM logs UNION ALL SELECT -1, '{words}'), {_HASHED}, q AS (SELECT i, n FROM v WHERE id = -1), d AS (SELECT id, sum(v.n * coalesce(q.n, 0)) / (sqrt(sum(v.n * v.n)) * (SELECT sqrt(sum(n * n)) FROM q)) AS score FROM v LEFT JOIN q USING (i) WHERE id >= 0 GROUP BY id),
hits AS (SELECT event_id, service, score FROM d JOIN logs ON event_id = id WHERE score >= 0.5 ORDER BY round(score, 6) DESC, ts LIMIT {k})"""


@query("e2_cosine", "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 5) AS similarity FROM embeddings, q")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    q = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q")))
    return rounded(e.crossJoin(q).select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("similarity")), "similarity", digits=5)


@query("e3_centroid_outliers", "WITH x AS (SELECT unnest(embedding) AS v, unnest(range(1, 65)) AS p FROM embeddings), c AS (SELECT list(v ORDER BY p) AS c FROM (SELECT p, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY p)) SELECT vec_id FROM embeddings, c WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) < 0.2")
def _(spark, sf):
    return V.centroid_outliers(table(spark, sf, "embeddings"), "embedding", 0.2).select("vec_id")


@query("e4_semantic_search", f"WITH {_searched('failed request type error', 20)} SELECT event_id, round(score, 4) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS grade FROM hits")
def _(spark, sf):
    return rounded(V.semantic_search(logs(spark, sf), "failed request type error", 20).select("event_id", "score", "grade"), "score")


@query("e5_lexical_search", f"WITH {LOGS}, s AS (SELECT event_id, ts, 2 * CAST(contains(lower(message), 'failed') AS INT) + 2 * CAST(contains(lower(message), 'signup') AS INT) + CAST(contains(concat_ws(' ', service, level), 'warn') AS INT) * 0 AS s FROM logs) SELECT event_id, round(s / (s + 1.0), 6) AS score FROM s WHERE s > 0 ORDER BY s DESC, ts DESC, event_id LIMIT 10")
def _(spark, sf):
    return rounded(V.lexical_search(logs(spark, sf), "failed signup").select("event_id", "score"), "score", digits=6)


@query("e6_similar_pairs")
def _(spark, sf):
    return rounded(V.similar_classes(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.5), "similarity")


@query("e9_search_report", f"WITH {_searched('failed request', 50)} SELECT count(*) AS hits, round(avg(score), 4) AS mean, round(max(score), 4) AS max, round(min(score), 4) AS min, count(DISTINCT service) AS services, CASE WHEN avg(score) >= 0.8 THEN 'high' WHEN avg(score) >= 0.6 THEN 'medium' WHEN avg(score) >= 0.4 THEN 'low' ELSE 'weak' END AS relevance FROM hits")
def _(spark, sf):
    return rounded(V.search_report(V.semantic_search(logs(spark, sf), "failed request", 50)), "mean", "max", "min")


@query("e10_kmeans")
def _(spark, sf):
    return V.cluster(table(spark, sf, "embeddings"), "vec_id", "embedding", 10, least=2).groupBy("cluster").agg(F.count("*").alias("size"))


@query("e11_cosine_kmeans")
def _(spark, sf):
    return V.cluster(table(spark, sf, "embeddings"), "vec_id", "embedding", 10, measure="cosine", rounds=25).groupBy("cluster").agg(F.count("*").alias("size"))


@query("e12_log_clusters")
def _(spark, sf):
    e = V.embed_column(logs(spark, sf).select("event_id", "message"), "message", dim=64)
    c = V.cluster(e, "event_id", "embedding", 5, rounds=None)
    return c.groupBy("cluster").agg(F.count("*").alias("size"))


@query("e13_e14_trace_clusters")
def _(spark, sf):
    df = spans(spark, sf)
    e = V.embed_column(T.trace_text(df), "text", dim=64)
    c = V.cluster(e, "trace_id", "embedding", 6)
    return rounded(V.cluster_profile(N.trace_table(df).join(c, "trace_id")), "share", "mean", "std", "consistency")


@query("e15_embed_column")
def _(spark, sf):
    e = V.embed_column(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", dim=32)
    return e.select("conv_id", "turn", F.size("embedding").alias("dim"))


_FIELDS = {'trace_id': ('keyword', 'trace'), 'span_id': ('keyword', 'span'), 'parent_span_id': ('keyword', 'span'), 'service': ('keyword', 'service'), 'operation': ('keyword', 'other'), 'start_ts': ('date', 'other'), 'duration_ms': ('number', 'duration'), 'is_error': ('boolean', 'status'), 'error_type': ('keyword', 'status'), 'line': ('number', 'other'), 'user_id': ('number', 'other')}


@query("l2_fields", "WITH " + SPANS + " " + " UNION ALL ".join(f"SELECT '{n}' AS name, '{k}' AS type, '{r}' AS role, count({n}) AS n FROM spans" for n, (k, r) in _FIELDS.items()))
def _(spark, sf):
    return L.list_fields(spans(spark, sf), "*")


def _attributes():
    both = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("small"), F.when(F.col("value") < 20, F.lit("yes")))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def attributed(spark, sf):
    """Logs with the attributes of their JSON, and a field that few have."""
    df = table(spark, sf, "events")
    return df.select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"), F.when(F.col("value") > 50, F.col("value")).alias("high"), _attributes().alias("attributes"))


_FILLED = "e AS (SELECT list_filter(['event_id', CASE WHEN event_type <> 'view' THEN 'kind' END, CASE WHEN value > 50 THEN 'high' END, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 'attributes.k' END, CASE WHEN value < 20 THEN 'attributes.small' END], lambda x: x IS NOT NULL) AS f FROM events)"


@query("l3_field_pairs", f"WITH {_FILLED}, a AS (SELECT unnest(f) AS a, f FROM e), b AS (SELECT a, unnest(f) AS b FROM a) SELECT a, b, count(*) AS n FROM b WHERE a < b GROUP BY ALL")
def _(spark, sf):
    return L.field_pairs(attributed(spark, sf))


@query("l3_span_field_pairs", "WITH " + SPANS + ", e AS (SELECT list_filter([" + ", ".join(f"CASE WHEN {n} IS NOT NULL THEN '{n}' END" for n in _FIELDS) + "], lambda x: x IS NOT NULL) AS f FROM spans), a AS (SELECT unnest(f) AS a, f FROM e), b AS (SELECT a, unnest(f) AS b FROM a) SELECT a, b, count(*) AS n FROM b WHERE a < b GROUP BY ALL")
def _(spark, sf):
    return L.field_pairs(spans(spark, sf))


_NESTED = (
    ("event_id", "number", "other", "1"), ("who", "struct", "other", "1"), ("who.user_id", "number", "other", "CASE WHEN user_id IS NOT NULL THEN 1 ELSE 0 END"), ("who.what", "struct", "other", "1"), ("who.what.level", "keyword", "level", "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"),
    ("who.what.value", "number", "other", "CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END"), ("items", "array", "other", "1"), ("items[]", "struct", "other", "2"), ("items[].name", "keyword", "other", "2"), ("items[].high", "number", "other", "CASE WHEN value > 50 THEN 1 ELSE 0 END"),
    ("attributes", "map", "other", "1"), ("attributes{}", "keyword", "other", "CASE WHEN value < 20 THEN 1 ELSE 0 END + CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 1 ELSE 0 END"),
)


@query("cp29_nested_fields", " UNION ALL ".join(f"SELECT '{p}' AS path, '{k}' AS kind, '{r}' AS role, CAST(sum({n}) AS BIGINT) AS values, count(*) FILTER (WHERE {n} > 0) AS rows, count(*) FILTER (WHERE {n} = 0) AS nulls FROM events" for p, k, r, n in _NESTED).replace(" AS values,", ' AS "values",').replace(" AS rows,", ' AS "rows",'))
def _(spark, sf):
    df = table(spark, sf, "events")
    item = lambda high: F.struct(F.col("event_type").alias("name"), high.cast("double").alias("high"))
    who = F.struct("user_id", F.struct(F.when(F.col("event_type") == "error", "error").alias("level"), "value").alias("what"))
    nested = df.select("event_id", who.alias("who"), F.array(item(F.when(F.col("value") > 50, F.col("value"))), item(F.lit(None))).alias("items"), _attributes().alias("attributes"))
    return L.nested_fields(nested)


@query("l4_field_profile", f"WITH {SPANS} SELECT 'service' AS name, count(DISTINCT service) AS distinct, count(*) FILTER (WHERE service IS NULL) AS nulls FROM spans UNION ALL SELECT 'operation', count(DISTINCT operation), count(*) FILTER (WHERE operation IS NULL) FROM spans UNION ALL SELECT 'error_type', count(DISTINCT error_type), count(*) FILTER (WHERE error_type IS NULL) FROM spans")
def _(spark, sf):
    return L.field_profile(spans(spark, sf), ["service", "operation", "error_type"], exact=True).select("name", "distinct", "nulls")


@query("l5_service_fields", f"WITH {SPANS} SELECT service, 'error' AS field, count(*) AS n FROM spans WHERE error_type IS NOT NULL GROUP BY service UNION ALL SELECT service, 'service', count(*) FROM spans GROUP BY service")
def _(spark, sf):
    df = spans(spark, sf).withColumn("attributes", F.map_filter(F.create_map(F.lit("service"), "service", F.lit("error"), "error_type"), lambda k, v: v.isNotNull()))
    return L.service_fields(df)


@query("l6_json_fields", "SELECT 'k' AS field, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(spark, sf):
    return L.json_fields(table(spark, sf, "events"), "props")
