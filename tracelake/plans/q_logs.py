"""Log text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.operators import logtext as T
from tracelake.plans.fixtures import LOGS, SPANS, logs, spans, table
from tracelake.plans.registry import query


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


#: Template A in SQL. Messages of ``logs`` hold words and whole numbers only; other patterns are tested in t1_documents and by unit tests.
A = "regexp_replace(message, '\\b[0-9]+(\\.[0-9]+)?\\b', '{NUMBER}', 'g')"


@query("t1_template_a", f"WITH {LOGS} SELECT event_id, {A} AS template FROM logs")
def _(spark, sf):
    return logs(spark, sf).select("event_id", C.template_a(F.col("message")).alias("template"))


_HEX = "[0-9a-fA-F]"
_UUID = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"


def _chain(column, *steps):
    for pattern, to in steps:
        column = f"regexp_replace({column}, '{pattern}', '{to}', 'g')"
    return column


#: Both template styles over conversations and documents, written for DuckDB's own expressions; '' is a quote in SQL.
_WHOLE_A = _chain("text", (_UUID, "{UUID}"), (rf"\b{_HEX}{{24}}\b", "{HEX_ID}"), (r"\b[0-9]+(\.[0-9]+)?\b", "{NUMBER}"), (r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "{IP}"), (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z][a-zA-Z]+\b", "{EMAIL}"), (r"https?://[^\t\n\f\r\x0b ]+", "{URL}"), (r"/[^\t\n\f\r\x0b ]+", "{PATH}"), (r'"[^"]+"', "{STRING}"), ("''[^'']+''", "{STRING}"))
_WHOLE_B = _chain("text", (r"\b[0-9]+\b", "<NUM>"), (r"\b[0-9]+\.[0-9]+\b", "<FLOAT>"), (rf"\b{_UUID}\b", "<UUID>"), (rf"\b{_HEX}{{32}}\b", "<HASH>"), (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "<EMAIL>"), (r"\bhttps?://[^\t\n\f\r\x0b ]+", "<URL>"), (r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "<IP>"), (r"/[^/\t\n\f\r\x0b ]+/[^/\t\n\f\r\x0b ]+/[^/\t\n\f\r\x0b ]+", "<PATH>"))
_TEXTS = "texts AS (SELECT conv_id AS a, turn AS b, text FROM conversations UNION ALL SELECT doc_id, -1, text FROM documents)"


def texts(spark, sf):
    """Conversations and documents as (a, b, text)."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("a"), F.col("turn").alias("b"), "text")
    return turns.unionByName(table(spark, sf, "documents").select(F.col("doc_id").alias("a"), F.lit(-1).alias("b"), "text"))


@query("t1_t2_texts", f"WITH {_TEXTS} SELECT CAST(a AS VARCHAR) AS a, CAST(b AS BIGINT) AS b, md5({_WHOLE_A}) AS style_a, md5(trim({_WHOLE_B}, ' ')) AS style_b FROM texts")
def _(spark, sf):
    return texts(spark, sf).select(F.col("a").cast("string").alias("a"), F.col("b").cast("long").alias("b"), F.md5(C.template_a(F.col("text"))).alias("style_a"), F.md5(C.template_b(F.col("text"))).alias("style_b"))


@query("t2_template_b", f"WITH {LOGS} SELECT DISTINCT regexp_replace(message, '\\b[0-9]+\\b', '<NUM>', 'g') AS template FROM logs")
def _(spark, sf):
    return logs(spark, sf).select(C.template_b(F.col("message")).alias("template")).distinct()


@query("t3_t4_cp18_templates", f"WITH {LOGS} SELECT {A} AS template, count(*) AS count, round(count(*) / CAST((SELECT count(*) FROM logs) AS DOUBLE), 6) AS share, list_sort(list_distinct(list(level))) AS levels FROM logs GROUP BY 1 HAVING count(*) >= 2")
def _(spark, sf):
    return rounded(T.log_templates(logs(spark, sf), C.template_a(F.col("message"))).select("template", "count", "share", "levels"), "share", digits=6)


@query("t5_t6_template_changes", f"""WITH {LOGS}, t AS (SELECT {A} AS template, ts < TIMESTAMP '2024-01-10 00:00:00' AS early, level FROM logs WHERE level <> 'warn' OR ts < TIMESTAMP '2024-01-10 00:00:00'), n AS (SELECT early, count(*) AS n FROM t GROUP BY early), s AS (SELECT template, early, count(*) / CAST(any_value(n) AS DOUBLE) AS share FROM t JOIN n USING (early) GROUP BY ALL)
SELECT template, CASE WHEN b.share IS NULL THEN 'new' WHEN c.share IS NULL THEN 'missing' ELSE 'frequency' END AS kind FROM (SELECT * FROM s WHERE NOT early) c FULL OUTER JOIN (SELECT * FROM s WHERE early) b USING (template) WHERE b.share IS NULL OR c.share IS NULL OR abs(c.share - b.share) / b.share > 0.2""")
def _(spark, sf):
    early = F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    df = logs(spark, sf).filter((F.col("level") != "warn") | early)
    return T.template_changes(df.filter(~early), df.filter(early), C.template_a(F.col("message"))).select("template", "kind")


@query("t8_families", f"WITH {LOGS} SELECT CASE WHEN contains(message, 'failed') THEN 'Errors' ELSE 'HTTP' END AS family, count(*) AS count FROM logs GROUP BY 1")
def _(spark, sf):
    return logs(spark, sf).groupBy(T.families(C.template_a(F.col("message"))).alias("family")).agg(F.count("*").alias("count"))


@query("t9_j13_cooccurrence", f"""WITH {LOGS}, r AS (SELECT DISTINCT {A} AS t, time_bucket(INTERVAL '1 hour', ts) AS w FROM logs), n AS (SELECT t, count(*) AS n FROM r GROUP BY t)
SELECT x.t AS a, y.t AS b, count(*) AS both, round(count(*) / CAST(any_value(na.n) + any_value(nb.n) - count(*) AS DOUBLE), 6) AS jaccard FROM r x JOIN r y ON x.w = y.w AND x.t < y.t JOIN n na ON na.t = x.t JOIN n nb ON nb.t = y.t GROUP BY ALL""")
def _(spark, sf):
    return rounded(T.cooccurrence(logs(spark, sf), C.template_a(F.col("message")), 3600, 0.0), "jaccard", digits=6)


@query("t11_keywords", f"WITH {LOGS} SELECT level, count(*) AS n FROM logs WHERE contains(message, 'request') GROUP BY level")
def _(spark, sf):
    return logs(spark, sf).filter(F.array_contains(C.keywords(F.col("message")), "request")).groupBy("level").agg(F.count("*").alias("n"))


@query("t12_t13_itemsets", f"""WITH {LOGS}, i AS (SELECT event_id, unnest([concat('level:', level), concat('service:', service)]) AS item FROM logs)
SELECT concat(a.item, '|', b.item) AS items, count(*) AS count FROM i a JOIN i b ON a.event_id = b.event_id AND a.item < b.item GROUP BY 1 HAVING count(*) >= 0.01 * (SELECT count(*) FROM logs)""")
def _(spark, sf):
    found = T.itemsets(T.transactions(logs(spark, sf), "event_id"), 0.01)
    pair = (F.size(F.split("items", r"\|")) == 2) & F.col("items").startswith("level:") & F.contains("items", F.lit("|service:"))
    return found.filter(pair).select("items", "count")


@query("t14_rules", f"""WITH {LOGS}, p AS (SELECT concat('service:', service) AS a, concat('level:', level) AS c, count(*) AS n FROM logs GROUP BY ALL), t AS (SELECT concat('service:', service) AS a, count(*) AS n FROM logs GROUP BY 1) SELECT p.a AS antecedent, p.c AS consequent, round(p.n / CAST(t.n AS DOUBLE), 6) AS confidence FROM p JOIN t USING (a) WHERE p.n / CAST(t.n AS DOUBLE) >= 0.5""")
def _(spark, sf):
    rules = T.association_rules(T.itemsets(T.transactions(logs(spark, sf), "event_id"), 0.01))
    one = (F.size(F.split("antecedent", r"\|")) == 1) & F.col("antecedent").startswith("service:") & F.col("consequent").isin("level:info", "level:warn", "level:error")
    return rounded(rules.filter(one).select("antecedent", "consequent", "confidence"), "confidence", digits=6)


@query("t15_sequence_pairs", f"""WITH {LOGS}, f AS (SELECT service, time_bucket(INTERVAL '6 hours', ts) AS w, level, min(ts) AS f, max(ts) AS l FROM logs GROUP BY ALL), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT service, w FROM f))
SELECT x.level AS a, y.level AS b, count(*) AS count, round(count(*) / CAST(any_value(n.n) AS DOUBLE), 6) AS support FROM f x JOIN f y ON x.service = y.service AND x.w = y.w AND x.level <> y.level AND y.l > x.f, n GROUP BY ALL""")
def _(spark, sf):
    ev = logs(spark, sf).withColumn("w", F.window("ts", "6 hours")["start"])
    return rounded(T.sequence_pairs(ev, ["service", "w"], "level", "ts").select("a", "b", "count", "support"), "support", digits=6)


@query("t15_prefix_sequences")
def _(spark, sf):
    return T.prefix_sequences(logs(spark, sf).withColumn("w", F.window("ts", "6 hours")["start"]), ["service", "w"], "level", "ts")


@query("t16_itemset_change", f"""WITH {LOGS}, s AS (SELECT ts < TIMESTAMP '2024-01-15 00:00:00' AS early, concat('level:', level, '|service:', service) AS items, count(*) AS n FROM logs GROUP BY ALL) SELECT items, c.n AS current_count, b.n AS baseline_count, CASE WHEN b.n IS NULL THEN 'new' WHEN c.n IS NULL THEN 'removed' ELSE 'both' END AS state FROM (SELECT * FROM s WHERE NOT early) c FULL OUTER JOIN (SELECT * FROM s WHERE early) b USING (items)""")
def _(spark, sf):
    from tracelake.operators.aggregate import compare_periods

    early = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    pair = (F.size(F.split("items", r"\|")) == 2) & F.col("items").startswith("level:") & F.contains("items", F.lit("|service:"))
    sets = lambda d: T.itemsets(T.transactions(d, "event_id"), 0.001).filter(pair)
    return compare_periods(sets(logs(spark, sf).filter(~early)), sets(logs(spark, sf).filter(early)), ["items"], ["count"])


@query("t17_entities", f"WITH {LOGS} SELECT 'SERVICE' AS type, service AS value, count(*) AS count FROM logs GROUP BY ALL")
def _(spark, sf):
    return T.entities(logs(spark, sf), F.col("message"), F.col("service"))


_ENTITIES = (("IP", r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"), ("URL", r"(https?://[^\t\n\f\r\x0b ]+)"), ("EMAIL", r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"), ("ERROR_CODE", r"\b((?:[eE][rR][rR][oO][rR]|[eE][rR][rR]|[wW][aA][rR][nN])[-_]?[0-9]+)\b"), ("FILE_PATH", r"((?:/[a-zA-Z0-9_.-]+)+)"), ("USER", r"\b(?:[uU][sS][eE][rR]|[uU][iI][dD]|[uU][sS][eE][rR][nN][aA][mM][eE])[:=][\t\n\f\r\x0b ]*([a-zA-Z0-9_]+)"))


@query("t17_text_entities", f"WITH {_TEXTS}, found AS (" + " UNION ALL ".join(f"SELECT '{k}' AS type, unnest(regexp_extract_all(text, '{p}', 1)) AS value FROM texts" for k, p in _ENTITIES) + ") SELECT type, value, count(*) AS count FROM found GROUP BY ALL")
def _(spark, sf):
    return T.entities(texts(spark, sf), F.col("text"))


@query("t18_cp20_sentiment", f"""WITH {LOGS}, s AS (SELECT service, CAST(contains(message, 'completed') AS INT) - CAST(contains(message, 'error') AS INT) - CAST(contains(message, 'fail') AS INT) - CASE level WHEN 'error' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END AS s FROM logs)
SELECT service, count(*) FILTER (WHERE s > 1) AS positive, count(*) FILTER (WHERE s BETWEEN -1 AND 1) AS neutral, count(*) FILTER (WHERE s < -1) AS negative, round(avg(s), 6) AS mean FROM s GROUP BY service""")
def _(spark, sf):
    return rounded(T.sentiment_by(logs(spark, sf), ["service"]).drop("overall"), "mean", digits=6)


_STOP = ", ".join(f"'{w}'" for w in T.STOP)


@query("t19_key_phrases", f"""WITH w AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2) AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT unnest(list_concat(list_transform(range(1, len(w)), lambda i: w[i:i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) AS g FROM w),
c AS (SELECT g, count(*) AS count FROM g WHERE len(list_filter(g, lambda x: x NOT IN ({_STOP}))) > 0 GROUP BY g HAVING count(*) >= 3) SELECT array_to_string(g, ' ') AS phrase, count, round(count * ln(len(g) + 1), 4) AS score FROM c ORDER BY count * ln(len(g) + 1) DESC, phrase LIMIT 20""")
def _(spark, sf):
    return rounded(T.key_phrases(table(spark, sf, "documents"), F.col("text")), "score")


@query("t20_languages", """WITH t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}]+') AS w FROM documents), h AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('der','die','und','das','ist','nicht','ein','eine','zu','den'))) AS de, len(list_filter(w, lambda x: x IN ('the','and','of','to','in','is','that','it','was','for'))) AS en, len(list_filter(w, lambda x: x IN ('el','la','de','que','y','en','los','se','del','las'))) AS es, len(list_filter(w, lambda x: x IN ('le','la','les','de','des','et','un','une','dans','que'))) AS fr FROM t)
SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'unknown' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS language FROM h""")
def _(spark, sf):
    return T.languages(table(spark, sf, "documents"), F.col("text"), "doc_id")


@query("t21_summary", f"WITH {LOGS} SELECT count(*) AS logs, count(DISTINCT service) AS services, count(DISTINCT {A}) AS templates FROM logs")
def _(spark, sf):
    return logs(spark, sf).agg(F.count("*").alias("logs"), F.count_distinct("service").alias("services"), F.count_distinct(C.template_a(F.col("message"))).alias("templates"))


@query("t22_error_class", f"WITH {SPANS} SELECT CASE error_type WHEN 'Timeout' THEN 'timeout' WHEN 'Connection' THEN 'connection' ELSE 'memory' END AS class, count(*) AS n FROM spans WHERE is_error GROUP BY 1")
def _(spark, sf):
    return spans(spark, sf).filter("is_error").groupBy(C.error_class(F.col("error_type")).alias("class")).agg(F.count("*").alias("n"))


@query("t23_themes", f"WITH {LOGS}, w AS (SELECT unnest(regexp_split_to_array(lower(message), '[^a-z0-9]+')) AS word FROM logs) SELECT word, count(*) AS count FROM w WHERE length(word) > 3 GROUP BY word ORDER BY count DESC, word LIMIT 5")
def _(spark, sf):
    return T.themes(logs(spark, sf), F.col("message"))


@query("t24_common_terms", f"WITH {LOGS}, w AS (SELECT DISTINCT event_id, level, unnest(regexp_split_to_array(lower(message), '[^a-z0-9]+')) AS term FROM logs), n AS (SELECT level, count(*) AS n FROM logs GROUP BY level) SELECT w.level, term, count(*) AS count FROM w JOIN n USING (level) WHERE length(term) > 2 GROUP BY ALL HAVING count(*) >= greatest(2, any_value(n) / 2.0)")
def _(spark, sf):
    return T.common_terms(logs(spark, sf), "level", F.col("message"))


@query("t25_flatten_text", f"WITH {LOGS} SELECT event_id, concat_ws(' ', message, concat('level:\"', level, '\"'), CAST(user_id AS VARCHAR)) AS text FROM logs")
def _(spark, sf):
    return logs(spark, sf).select("event_id", T.flatten_text([F.col("message")], [F.create_map(F.lit("level"), "level")], [F.col("user_id")]).alias("text"))


@query("t26_trace_text", f"WITH {SPANS} SELECT trace_id, array_to_string(list(concat_ws(' ', service, operation, CASE WHEN is_error THEN concat_ws(' ', 'error', error_type) END) ORDER BY start_ts, span_id), ' ') AS text FROM spans GROUP BY trace_id")
def _(spark, sf):
    return T.trace_text(spans(spark, sf))


@query("t27_error_clusters", f"WITH {SPANS} SELECT error_type AS type, substring(operation, 1, 50) AS prefix, count(*) AS count FROM spans WHERE is_error GROUP BY ALL ORDER BY count DESC, type, prefix LIMIT 10")
def _(spark, sf):
    return T.error_clusters(spans(spark, sf).filter("is_error"), F.col("error_type"), F.col("operation")).select("type", "prefix", "count")


@query("t28_hit_distribution", f"WITH {LOGS}, g AS (SELECT service, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY service ORDER BY ts)) / 1000000.0 AS g FROM logs WHERE level = 'error') SELECT service, CASE WHEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 < 60 THEN 'burst' WHEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 < 300 THEN 'rapid' WHEN max(g) > 5 * avg(g) THEN 'intermittent' ELSE 'continuous' END AS kind FROM g GROUP BY service")
def _(spark, sf):
    return T.hit_distribution(logs(spark, sf).filter("level = 'error'"), ["service"], "ts").select("service", "kind")
