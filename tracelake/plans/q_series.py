"""Series, histogram and anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.operators import anomaly as X
from tracelake.operators import histogram as H
from tracelake.operators import series as R
from tracelake.operators import spans as N
from tracelake.operators.density import density_clusters
from tracelake.plans.fixtures import LOGS, METRICS, SPANS, logs, metrics, spans, table
from tracelake.plans.registry import query

M = ["metric"]


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


def daily(spark, sf):
    return R.to_series(metrics(spark, sf), "ts", F.avg("value"), 86400, M)


def six_hours(spark, sf):
    return R.to_series(metrics(spark, sf), "ts", F.avg("value"), 21600, M)


def _series(seconds):
    step = {86400: "1 day", 21600: "6 hours", 3600: "1 hour"}[seconds]
    return f"""{METRICS}, raw AS (SELECT metric, time_bucket(INTERVAL '{step}', ts) AS ts, avg(value) AS value FROM metrics GROUP BY ALL),
e AS (SELECT metric, unnest(generate_series(min(ts), max(ts), INTERVAL '{step}')) AS ts FROM raw GROUP BY metric),
s AS (SELECT e.metric, e.ts, coalesce(raw.value, 0.0) AS value, CAST(row_number() OVER (PARTITION BY e.metric ORDER BY e.ts) - 1 AS INT) AS i FROM e LEFT JOIN raw USING (metric, ts))"""


S1, S6 = _series(86400), _series(21600)


@query("r1_series", f"WITH {S6} SELECT metric, ts, round(value, 8) AS value, i FROM s")
def _(spark, sf):
    return rounded(six_hours(spark, sf), "value", digits=8)


@query("r2_log_volume", f"WITH {LOGS} SELECT time_bucket(INTERVAL '6 hours', ts) AS ts, CAST(count(*) AS DOUBLE) AS value FROM logs GROUP BY 1")
def _(spark, sf):
    return logs(spark, sf).groupBy(F.window("ts", "6 hours")["start"].alias("ts")).agg(F.count("*").cast("double").alias("value"))


@query("r3_fill_missing", f"""WITH {S1}, g AS (SELECT metric, i, CASE WHEN i % 3 <> 1 THEN value END AS value FROM s), n AS (SELECT metric, i, value, lag(value) OVER w AS p, lead(value) OVER w AS n FROM g WINDOW w AS (PARTITION BY metric ORDER BY i)) SELECT metric, i, round(coalesce(value, p + (n - p) * 0.5, p, n, 0), 8) AS value FROM n""")
def _(spark, sf):
    holes = daily(spark, sf).withColumn("value", F.when(F.col("i") % 3 != 1, F.col("value")))
    return rounded(R.fill_missing(holes, M).select("metric", "i", "value"), "value", digits=8)


@query("r4_sma", f"WITH {S1} SELECT metric, i, round(avg(value) OVER (PARTITION BY metric ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smooth FROM s")
def _(spark, sf):
    return rounded(R.smooth(daily(spark, sf), M, "sma", 5).select("metric", "i", "smooth"), "smooth")


@query("r4_w14_ema", f"WITH RECURSIVE {S1}, em AS (SELECT metric, i, value AS smooth FROM s WHERE i = 0 UNION ALL SELECT s.metric, s.i, (1.0 / 3) * s.value + (1 - 1.0 / 3) * em.smooth FROM em JOIN s ON s.metric = em.metric AND s.i = em.i + 1) SELECT metric, i, round(smooth, 4) AS smooth FROM em")
def _(spark, sf):
    return rounded(R.smooth(daily(spark, sf), M, "ema", 5).select("metric", "i", "smooth"), "smooth")


@query("r5_statistics", f"WITH {S1} SELECT metric, round(avg(value), 4) AS mean, round(list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1], 4) AS median, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, round(stddev_pop(value) / avg(value), 6) AS cv FROM s GROUP BY metric")
def _(spark, sf):
    return rounded(rounded(R.statistics(daily(spark, sf), M), "mean", "median", "std", "min", "max"), "cv", digits=6)


@query("r6_r9_trend", f"WITH {S1} SELECT metric, round(regr_slope(value, CAST(i AS DOUBLE)), 5) AS slope, round(regr_r2(value, CAST(i AS DOUBLE)), 6) AS r2, round(regr_slope(value, CAST(i AS DOUBLE)) / avg(value), 6) AS normalised, CASE WHEN abs(regr_slope(value, CAST(i AS DOUBLE))) <= 0.01 THEN 'stable' WHEN regr_slope(value, CAST(i AS DOUBLE)) > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM s GROUP BY metric")
def _(spark, sf):
    t = R.trend(daily(spark, sf), M).select("metric", "slope", "r2", "normalised", "direction")
    return rounded(rounded(t, "slope", digits=5), "r2", "normalised", digits=6)


@query("r10_seasonality", f"WITH {S6}, p AS (SELECT unnest([24, 7, 30]) AS period), o AS (SELECT metric, period, i % period AS o, max(value) - min(value) AS d FROM s, p GROUP BY ALL) SELECT metric, period, round(max(d), 4) AS amplitude FROM o GROUP BY ALL")
def _(spark, sf):
    return rounded(R.seasonality(six_hours(spark, sf), M), "amplitude")


@query("r11_w6_autocorrelation", f"WITH {S6}, d AS (SELECT metric, i, value - avg(value) OVER (PARTITION BY metric) AS d, var_pop(value) OVER (PARTITION BY metric) AS v FROM s), l AS (SELECT a.metric, k.lag, avg(a.d * b.d) / max(a.v) AS c FROM d a CROSS JOIN (SELECT unnest([12, 24, 48]) AS lag) k JOIN d b ON b.metric = a.metric AND b.i = a.i - k.lag GROUP BY ALL) SELECT metric, lag, round(c, 6) AS correlation, c > 0.3 AS seasonal FROM l")
def _(spark, sf):
    return rounded(R.autocorrelation(six_hours(spark, sf), M), "correlation", digits=6)


@query("r13_seasonal_adjust", f"WITH {S6} SELECT metric, i, round(value - avg(value) OVER (PARTITION BY metric, i % 4) + avg(value) OVER (PARTITION BY metric), 4) AS adjusted FROM s")
def _(spark, sf):
    return rounded(R.seasonal_adjust(six_hours(spark, sf), M, 4).select("metric", "i", "adjusted"), "adjusted")


@query("r14_change_points", f"""WITH {S6}, f AS (SELECT metric, i, avg(value) OVER a AS m0, stddev_pop(value) OVER a AS s0, count(*) OVER a AS n0, avg(value) OVER b AS m1, stddev_pop(value) OVER b AS s1, count(*) OVER b AS n1 FROM s WINDOW a AS (PARTITION BY metric ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY metric ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT metric, i, CASE WHEN abs(m1 - m0) > 2 * s0 THEN 'mean' ELSE 'variance' END AS kind FROM f WHERE n0 = 10 AND n1 = 10 AND (abs(m1 - m0) > 2 * s0 OR s1 / s0 > 2 OR s1 / s0 < 0.5)""")
def _(spark, sf):
    return R.change_points(six_hours(spark, sf), M).select("metric", "i", "kind")


@query("r15_forecast", f"WITH {S1}, m AS (SELECT metric, arg_max(value, i) AS l, regr_slope(value, CAST(i AS DOUBLE)) AS b, stddev_pop(value) AS s, count(*) AS n FROM s GROUP BY metric) SELECT metric, CAST(k AS INT) AS k, round(l + b * k, 4) AS forecast, round(l + b * k - 1.96 * s * sqrt(1 + 1.0 / n + k * k / CAST(n AS DOUBLE)), 4) AS lower, round(l + b * k + 1.96 * s * sqrt(1 + 1.0 / n + k * k / CAST(n AS DOUBLE)), 4) AS upper FROM m, (SELECT unnest(range(1, 8)) AS k)")
def _(spark, sf):
    return rounded(R.forecast(daily(spark, sf), M, 7), "forecast", "lower", "upper")


_CANDIDATES = """{x}n AS (SELECT metric, count(*) AS n, arg_min(value, i) AS a, arg_max(value, i) AS z FROM {x} GROUP BY metric), {x}k AS (SELECT metric, avg(value) AS sma FROM {x} JOIN {x}n USING (metric) WHERE i >= n - greatest(1, least(5, floor(n / 4))) GROUP BY metric),
{x}e AS (SELECT metric, i, value AS ses FROM {x} WHERE i = 0 UNION ALL SELECT s.metric, s.i, 0.3 * s.value + 0.7 * e.ses FROM {x}e e JOIN {x} s ON s.metric = e.metric AND s.i = e.i + 1), {x}c AS (SELECT metric, CAST(k AS INT) AS k, sma, z + (z - a) / (n - 1) * k AS drift, ses FROM {x}n JOIN {x}k USING (metric) JOIN (SELECT metric, arg_max(ses, i) AS ses FROM {x}e GROUP BY metric) USING (metric), (SELECT unnest(range(1, 100)) AS k)),
{x}l AS (SELECT metric, k, unnest(['sma', 'drift', 'ses']) AS method, unnest([sma, drift, ses]) AS forecast FROM {x}c)"""


@query("r16_r17_chosen_forecast", f"""WITH RECURSIVE {S1}, cut AS (SELECT metric, greatest(1, floor(count(*) * 0.8)) AS c FROM s GROUP BY metric), tr AS (SELECT s.* FROM s JOIN cut USING (metric) WHERE i < c), te AS (SELECT metric, CAST(i - c + 1 AS INT) AS k, value FROM s JOIN cut USING (metric) WHERE i >= c),
{_CANDIDATES.format(x='tr')}, {_CANDIDATES.format(x='s')}, er AS (SELECT metric, method, avg(abs((forecast - value) / nullif(value, 0)) * 100) AS mape, sqrt(avg((forecast - value) ** 2)) AS rmse FROM te JOIN trl USING (metric, k) GROUP BY ALL), be AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY coalesce(mape, 1e18), method) AS q FROM er), sd AS (SELECT metric, stddev_pop(value) AS sd FROM s GROUP BY metric)
SELECT metric, method, round(mape, 4) AS mape, round(rmse, 4) AS rmse, k, round(forecast, 4) AS forecast, round(greatest(0.0, forecast - 1.96 * sd), 4) AS lower, round(forecast + 1.96 * sd, 4) AS upper FROM be JOIN sl USING (metric, method) JOIN sd USING (metric) WHERE q = 1 AND k <= 7""")
def _(spark, sf):
    return rounded(R.choose_forecast(daily(spark, sf), M, 7), "mape", "rmse", "forecast", "lower", "upper")


@query("r18_forecast_summary", f"WITH {S1}, m AS (SELECT metric, arg_max(value, i) AS l, regr_slope(value, CAST(i AS DOUBLE)) AS b FROM s GROUP BY metric) SELECT metric, round(b * 7 / l * 100, 4) AS change FROM m")
def _(spark, sf):
    s = daily(spark, sf)
    return rounded(R.forecast_summary(s, R.forecast(s, M, 7), M).select("metric", "change"), "change")


@query("r19_correlations", f"WITH {S6} SELECT a.metric AS a, b.metric AS b, round(corr(a.value, b.value), 6) AS correlation, count(*) AS n FROM s a JOIN s b ON a.ts = b.ts AND a.metric < b.metric GROUP BY ALL HAVING abs(corr(a.value, b.value)) >= 0.0")
def _(spark, sf):
    return rounded(R.correlations(six_hours(spark, sf), "metric", least=0.0).select("a", "b", "correlation", "n"), "correlation", digits=6)


@query("r20_cross_correlation", f"""WITH {S1}, l AS (SELECT unnest(range(-7, 8)) AS lag), c AS (SELECT a.metric AS a, b.metric AS b, l.lag, corr(a.value, b.value) AS c FROM s a CROSS JOIN l JOIN s b ON b.i = a.i + l.lag AND a.metric < b.metric GROUP BY ALL)
SELECT a, b, arg_max(lag, abs(c)) AS lag, round(arg_max(c, abs(c)), 6) AS correlation FROM c GROUP BY a, b""")
def _(spark, sf):
    c = R.cross_correlation(daily(spark, sf), "metric").select("a", "b", F.col("lag").cast("long").alias("lag"), "correlation")
    return rounded(c, "correlation", digits=6)


@query("r21_similarity", f"""WITH {S1}, t AS (SELECT metric, regr_slope(value, CAST(i AS DOUBLE)) AS s, stddev_pop(value) / avg(value) AS c FROM s GROUP BY metric)
SELECT a.metric AS a, b.metric AS b, round((2 - abs(a.s - b.s) / greatest(abs(a.s), abs(b.s)) - abs(a.c - b.c) / greatest(abs(a.c), abs(b.c))) / 2, 6) AS similarity FROM t a JOIN t b ON a.metric < b.metric""")
def _(spark, sf):
    return rounded(R.similarity(daily(spark, sf), M), "similarity", digits=6)


@query("r22_compare_series", f"WITH {S1}, a AS (SELECT * FROM s WHERE metric = 'click'), b AS (SELECT * FROM s WHERE metric = 'view') SELECT round((sum(a.value) - sum(b.value)) / sum(b.value) * 100, 4) AS volume_change, round(corr(a.value, b.value), 6) AS correlation FROM a JOIN b USING (i)")
def _(spark, sf):
    s = daily(spark, sf)
    c = R.compare_series(s.filter("metric = 'click'"), s.filter("metric = 'view'")).select("volume_change", "correlation")
    return rounded(rounded(c, "volume_change"), "correlation", digits=6)


@query("r23_metric_statistics", f"WITH {METRICS} SELECT metric, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 4) AS avg, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.99), 4) AS p99 FROM metrics GROUP BY metric")
def _(spark, sf):
    out = metrics(spark, sf).groupBy("metric").agg(F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.stddev_pop("value").alias("std"), F.percentile("value", F.lit(0.25)).alias("p25"), F.percentile("value", F.lit(0.99)).alias("p99"))
    return rounded(out, "avg", "std", "p25", "p99")


@query("r24_resource_trend", f"WITH {S1}, m AS (SELECT metric, arg_max(value, i) AS c, regr_slope(value, CAST(i AS DOUBLE)) AS b FROM s GROUP BY metric), h AS (SELECT *, CASE WHEN c >= 80 THEN 0.0 WHEN b > 0 THEN (80 - c) / (b * 2) END AS h FROM m) SELECT metric, round(c, 4) AS current, round(c + b * 48, 4) AS projected, coalesce(h < 24, false) AS at_risk FROM h")
def _(spark, sf):
    return rounded(R.resource_trend(daily(spark, sf), M, 80.0).select("metric", "current", "projected", "at_risk"), "current", "projected")


_ENDINGS = ("", ".count", "_gauge", ".histogram.bytes", ".distribution", "_summary_ms", ".duration", "_total_seconds", ".cpu.percent", "_hit_ratio")
_NAMES = "names AS (SELECT DISTINCT concat(event_type, x) AS name FROM events, (VALUES " + ", ".join(f"('{x}')" for x in _ENDINGS) + ") v(x))"


@query("d5_metric_kind", f"WITH {_NAMES} SELECT name, CASE WHEN name LIKE '%count%' THEN 'counter' WHEN name LIKE '%gauge%' THEN 'gauge' WHEN name LIKE '%histogram%' OR name LIKE '%distribution%' THEN 'histogram' WHEN name LIKE '%summary%' THEN 'summary' ELSE 'gauge' END AS kind, CASE WHEN name LIKE '%bytes%' THEN 'bytes' WHEN name LIKE '%seconds%' OR name LIKE '%duration%' THEN 'seconds' WHEN name LIKE '%!_ms%' ESCAPE '!' THEN 'milliseconds' WHEN name LIKE '%percent%' OR name LIKE '%ratio%' THEN 'percent' WHEN name LIKE '%count%' THEN 'count' ELSE '' END AS unit FROM names")
def _(spark, sf):
    names = table(spark, sf, "events").select("event_type").distinct().select(F.explode(F.array(*[F.concat("event_type", F.lit(x)) for x in _ENDINGS])).alias("name"))
    return names.select("name", C.metric_kind(F.col("name")).alias("kind"), C.metric_unit(F.col("name")).alias("unit"))


# histograms


@query("h1_histogram_stats", f"""WITH {METRICS}, h AS (SELECT metric, CAST(floor(value / 25) * 25 AS DOUBLE) AS key, count(*) AS count FROM metrics GROUP BY ALL), m AS (SELECT metric, sum(count) AS n, sum(key * count) / sum(count) AS mean FROM h GROUP BY metric),
d AS (SELECT metric, any_value(n) AS n, any_value(mean) AS mean, sqrt(sum((key - mean) ** 2 * count) / any_value(n)) AS std, sum((key - mean) ** 3 * count) / any_value(n) AS m3, sum((key - mean) ** 4 * count) / any_value(n) AS m4, arg_max(key, struct_pack(c := count, k := -key)) AS mode FROM h JOIN m USING (metric) GROUP BY metric)
SELECT metric, CAST(n AS BIGINT) AS n, round(mean, 4) AS mean, round(std, 4) AS std, mode, round(sqrt(CAST(n * (n - 1) AS DOUBLE)) / (n - 2) * m3 / std ** 3, 5) AS skewness, round(m4 / std ** 4 - 3, 5) AS kurtosis FROM d""")
def _(spark, sf):
    s = H.histogram_stats(histogram(spark, sf), M).select("metric", "n", "mean", "std", "mode", "skewness", "kurtosis")
    return rounded(rounded(s, "mean", "std"), "skewness", "kurtosis", digits=5)


def histogram(spark, sf):
    from tracelake.operators.aggregate import numeric_histogram

    return numeric_histogram(metrics(spark, sf), "value", 25.0, M)


_STATS = f"""WITH {METRICS}, h AS (SELECT metric, CAST(floor(value / 25) * 25 AS DOUBLE) AS key, count(*) AS count FROM metrics GROUP BY ALL), e AS (SELECT metric, CAST(floor(value / 25) * 25 AS DOUBLE) AS v FROM metrics),
m AS (SELECT metric, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, min(v) AS lo, max(v) AS hi FROM e GROUP BY metric)"""


@query("h2_h4_density_modes", _STATS + """, w AS (SELECT *, 0.9 * least(std, CASE WHEN p75 > p25 THEN (p75 - p25) / 1.34 ELSE std END) * n ** -0.2 AS bw FROM m), g AS (SELECT w.*, k, lo + (hi - lo) * k / 99 AS x FROM w, (SELECT unnest(range(0, 100)) AS k)),
d AS (SELECT g.metric, k, x, sum(exp(-0.5 * ((x - h.key) / bw) ** 2) / 2.5066282746310002 * h.count / (n * bw)) AS d FROM g JOIN h ON h.metric = g.metric GROUP BY ALL),
v AS (SELECT metric, x, d, lag(d) OVER q AS p, lead(d) OVER q AS nx, greatest(min(d) OVER (PARTITION BY metric ORDER BY k ROWS UNBOUNDED PRECEDING), min(d) OVER (PARTITION BY metric ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vl, max(d) OVER (PARTITION BY metric) AS top FROM d WINDOW q AS (PARTITION BY metric ORDER BY k))
SELECT metric, round(x, 6) AS x, round((d - vl) / top, 6) AS prominence FROM v WHERE d > coalesce(p, 0) AND d >= coalesce(nx, 0) AND (d - vl) / top >= 0.01""")
def _(spark, sf):
    return rounded(H.modes(H.density(histogram(spark, sf), M), M, 0.01), "x", "prominence", digits=6).select("metric", "x", "prominence")


_HP = f"WITH {METRICS}, h AS (SELECT metric, CAST(floor(value / 25) * 25 AS DOUBLE) AS key, count(*) AS count FROM metrics GROUP BY ALL), x AS (SELECT metric, key, count / CAST(sum(count) OVER (PARTITION BY metric) AS DOUBLE) AS p FROM h)"


@query("h3_divergences", _HP + """, j AS (SELECT key, coalesce(a.p, 0.0) AS p, coalesce(b.p, 0.0) AS q FROM (SELECT * FROM x WHERE metric = 'click') a FULL OUTER JOIN (SELECT * FROM x WHERE metric = 'view') b USING (key)), g AS (SELECT *, (p + q) / 2 AS m, abs(sum(p) OVER (ORDER BY key) - sum(q) OVER (ORDER BY key)) AS gap FROM j)
SELECT round(sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END), 8) AS kl, round(sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2, 8) AS js, round(avg(gap), 8) AS wasserstein FROM g""")
def _(spark, sf):
    h = histogram(spark, sf)
    return rounded(H.divergences(h.filter("metric = 'click'"), h.filter("metric = 'view'")).select("kl", "js", "wasserstein"), "kl", "js", "wasserstein", digits=8)


@query("h5_h6_compare", _STATS + """, x AS (SELECT metric, key, count / CAST(sum(count) OVER (PARTITION BY metric) AS DOUBLE) AS p FROM h), j AS (SELECT key, coalesce(a.p, 0.0) AS p, coalesce(b.p, 0.0) AS q FROM (SELECT * FROM x WHERE metric = 'click') a FULL OUTER JOIN (SELECT * FROM x WHERE metric = 'view') b USING (key)), g AS (SELECT *, (p + q) / 2 AS m, abs(sum(p) OVER (ORDER BY key) - sum(q) OVER (ORDER BY key)) AS gap FROM j),
d AS (SELECT sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2 AS js, avg(gap) AS w, sum(sqrt(p * q)) AS bc FROM g), s AS (SELECT a.mean AS m1, a.std AS s1, b.mean AS m2, b.std AS s2 FROM m a, m b WHERE a.metric = 'click' AND b.metric = 'view')
SELECT round((exp(-js) + exp(-w) + bc) / 3, 6) AS similarity, CASE WHEN abs(m1 - m2) / greatest(s1, s2) > 0.5 AND abs(s1 - s2) / greatest(s1, s2) > 0.3 THEN 'different' WHEN abs(m1 - m2) / greatest(s1, s2) > 0.5 THEN 'shifted' WHEN abs(s1 - s2) / greatest(s1, s2) > 0.3 THEN 'scaled' ELSE 'similar' END AS shape FROM d, s""")
def _(spark, sf):
    h = histogram(spark, sf)
    return rounded(H.compare(h.filter("metric = 'click'"), h.filter("metric = 'view'")).select("similarity", "shape"), "similarity", digits=6)


@query("h7_j13_pairwise", _HP + """, n AS (SELECT DISTINCT metric FROM x), k AS (SELECT DISTINCT key FROM x), e AS (SELECT n.metric, k.key, coalesce(x.p, 0.0) AS p FROM n CROSS JOIN k LEFT JOIN x ON x.metric = n.metric AND x.key = k.key)
SELECT a.metric AS a, b.metric AS b, round((sum(CASE WHEN a.p > 0 THEN a.p * ln(a.p / ((a.p + b.p) / 2)) ELSE 0 END) + sum(CASE WHEN b.p > 0 THEN b.p * ln(b.p / ((a.p + b.p) / 2)) ELSE 0 END)) / 2, 8) AS js FROM e a JOIN e b ON a.key = b.key AND a.metric < b.metric GROUP BY ALL""")
def _(spark, sf):
    return rounded(H.pairwise_js(histogram(spark, sf), "metric").select("a", "b", "js"), "js", digits=8)


# anomalies


@query("x1a_zscore", f"WITH {S6}, z AS (SELECT metric, i, (value - avg(value) OVER (PARTITION BY metric)) / stddev_pop(value) OVER (PARTITION BY metric) AS z FROM s) SELECT metric, i, round(z, 6) AS z, CASE WHEN z > 0 THEN 'spike' ELSE 'dip' END AS kind FROM z WHERE abs(z) > 2.0")
def _(spark, sf):
    return rounded(X.detect_anomalies(six_hours(spark, sf), M).select("metric", "i", "z", "kind"), "z", digits=6)


@query("x1b_mad", f"""WITH {S6}, m AS (SELECT metric, list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS med FROM s GROUP BY metric), d AS (SELECT s.metric, s.i, s.value, med, abs(value - med) AS dev FROM s JOIN m USING (metric)), a AS (SELECT metric, list_sort(list(dev))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS mad FROM d GROUP BY metric)
SELECT metric, i, round(0.6745 * (value - med) / mad, 6) AS z FROM d JOIN a USING (metric) WHERE mad > 0 AND abs(0.6745 * (value - med) / mad) > 2.5""")
def _(spark, sf):
    return rounded(X.detect_anomalies(six_hours(spark, sf), M, "mad").select("metric", "i", "z"), "z", digits=6)


@query("x1c_percentile", f"WITH {S6}, b AS (SELECT metric, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM s GROUP BY metric) SELECT metric, i, CASE WHEN value > hi THEN 'spike' ELSE 'dip' END AS kind FROM s JOIN b USING (metric) WHERE value < lo OR value > hi")
def _(spark, sf):
    return X.detect_anomalies(six_hours(spark, sf), M, "percentile", 0.9).select("metric", "i", "kind")


@query("x1d_w4_isolation", f"""WITH {S6}, d AS (SELECT a.metric, a.i, sum(abs(b.value - a.value)) / (count(*) - 1) / max(abs(b.value - a.value)) AS score FROM s a JOIN s b ON a.metric = b.metric AND b.i BETWEEN a.i - 5 AND a.i + 5 GROUP BY ALL) SELECT metric, i, round(score, 6) AS score FROM d WHERE score > 0.5""")
def _(spark, sf):
    return rounded(X.detect_anomalies(six_hours(spark, sf), M, "isolation", 0.5).select("metric", "i", "score"), "score", digits=6)


@query("x1f_rate_change", f"WITH {S6}, z AS (SELECT metric, i, (value - avg(value) OVER (PARTITION BY metric)) / stddev_pop(value) OVER (PARTITION BY metric) AS z FROM s), a AS (SELECT CASE WHEN z > 0 THEN 'spike' ELSE 'dip' END AS kind, i < 60 AS early FROM z WHERE abs(z) > 2) SELECT kind, count(*) FILTER (WHERE NOT early) AS current, count(*) FILTER (WHERE early) AS baseline FROM a GROUP BY kind")
def _(spark, sf):
    a = X.detect_anomalies(six_hours(spark, sf), M)
    return X.anomaly_rate_change(a.filter("i >= 60"), a.filter("i < 60"), 300, 300).select("kind", "current", "baseline")


@query("x1h_threshold", f"WITH {S6}, z AS (SELECT metric, i, abs(value - avg(value) OVER (PARTITION BY metric)) AS d, stddev_pop(value) OVER (PARTITION BY metric) AS sd FROM s) SELECT metric, i, round(least(d / sd / 3, 1.0), 6) AS score FROM z WHERE d > sd * 1.75")
def _(spark, sf):
    return rounded(X.threshold_anomalies(six_hours(spark, sf), M, 0.75).select("metric", "i", "score"), "score", digits=6)


@query("x2_robust_outliers", f"WITH {SPANS}, m AS (SELECT service, quantile_cont(duration_ms, 0.5) AS m FROM spans GROUP BY service), d AS (SELECT s.service, span_id, abs(duration_ms - m) AS d FROM spans s JOIN m USING (service)), a AS (SELECT service, quantile_cont(d, 0.5) AS a FROM d GROUP BY service) SELECT span_id, round(0.6745 * d / a, 6) AS score FROM d JOIN a USING (service) WHERE 0.6745 * d / a > 2")
def _(spark, sf):
    out = X.outlier_scores(spans(spark, sf), ["duration_ms"], ["service"]).filter("score > 2")
    return rounded(out.select("span_id", "score"), "score", digits=6)


@query("x2_pca_outliers")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return rounded(X.outlier_scores(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], method="pca").filter("score > 2").select("l_orderkey", "l_linenumber", "score"), "score")


@query("x2_isolation_forest")
def _(spark, sf):
    df = spans(spark, sf).select("span_id", "duration_ms", F.col("line").cast("double").alias("line"))
    return rounded(X.outlier_scores(df, ["duration_ms", "line"], method="iforest").filter("score > 0.6").select("span_id", "score"), "score")


def _density(least: int) -> str:
    """SQL of density clusters over pts(id) and near(a, b), both ways and with itself."""
    return f"""core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {least}), reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b JOIN core c ON c.id = n.b), lab AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a),
out AS (SELECT p.id, min(l.cluster) AS cluster FROM pts p LEFT JOIN near n ON n.a = p.id LEFT JOIN lab l ON l.id = n.b GROUP BY p.id)"""


@query("x2_random_cut_forest")
def _(spark, sf):
    df = spans(spark, sf).select("span_id", "duration_ms", F.col("line").cast("double").alias("line"))
    return rounded(X.outlier_scores(df, ["duration_ms", "line"], method="rcf").filter("score > 20").select("span_id", "score"), "score")


@query("x3_density_three_columns", f"""WITH RECURSIVE pts AS (SELECT p_partkey AS id, p_size / 5.0 AS x, (p_retailprice - 900) / 20.0 AS y, length(p_name) / 2.0 AS z FROM part), near AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 0.49), {_density(6)} SELECT id, cluster FROM out""")
def _(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 5.0).alias("x"), ((F.col("p_retailprice") - 900) / 20.0).alias("y"), (F.char_length("p_name") / 2.0).alias("z"))
    return density_clusters(df, "id", ["x", "y", "z"], 0.7, 6)


@query("x3_density_noise", f"""WITH RECURSIVE {_series(86400)}, pts AS (SELECT concat(metric, '-', printf('%03d', i)) AS id, value / 10 AS x, i / 5.0 AS y FROM s), near AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.25), {_density(5)} SELECT id, cluster FROM out""")
def _(spark, sf):
    df = daily(spark, sf).withColumn("id", F.concat_ws("-", "metric", F.format_string("%03d", F.col("i").cast("int"))))
    return X.density_noise(df.withColumn("x", F.col("value") / 10).withColumn("y", F.col("i") / 5), "id", "x", "y", 0.5, 5)


@query("x4_rolling", f"WITH {S6}, f AS (SELECT metric, i, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY metric ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT metric, i, round((value - m) / s, 4) AS z FROM f WHERE n = 5 AND abs((value - m) / s) > 3")
def _(spark, sf):
    return rounded(X.rolling_anomalies(six_hours(spark, sf), M).select("metric", "i", "z"), "z")


@query("x5_volume_anomalies", f"""WITH {LOGS}, b AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS bucket FROM logs), p AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket), z AS (SELECT bucket, n, (n - (SELECT avg(n) FROM p)) / (SELECT stddev_pop(n) FROM p) AS z FROM p), k AS (SELECT b.bucket, z.n, z.z, message, row_number() OVER (PARTITION BY b.bucket ORDER BY ts, message) AS r FROM b JOIN z USING (bucket) WHERE z.z > 2)
SELECT bucket, n, round(z, 6) AS z, message FROM k WHERE r = floor(n / 2) + 1""")
def _(spark, sf):
    return rounded(X.volume_anomalies(logs(spark, sf), 3600, 2.0), "z", digits=6)


@query("x9_volume_spikes", f"WITH {LOGS}, p AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS n, count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warn') AS warnings FROM logs GROUP BY 1) SELECT * FROM p WHERE n > 1.5 * (SELECT avg(n) FROM p)")
def _(spark, sf):
    return X.volume_spikes(logs(spark, sf), 3600, 1.5)


_T = "regexp_replace(message, '[0-9]+', '#', 'g')"


@query("x6_message_anomalies", f"WITH {LOGS}, a AS (SELECT event_id, message, {_T} AS t FROM logs), n AS (SELECT t, count(*) AS n FROM a GROUP BY t), s AS (SELECT count(*) AS c, avg(length(message)) AS m, stddev_pop(length(message)) AS sd FROM a) SELECT event_id, CASE WHEN n / CAST(c AS DOUBLE) < 0.01 THEN 'rare_pattern' ELSE 'unusual_length' END AS kind FROM a JOIN n USING (t), s WHERE n / CAST(c AS DOUBLE) < 0.01 OR abs(length(message) - m) > 2 * sd")
def _(spark, sf):
    return X.message_anomalies(logs(spark, sf), F.regexp_replace("message", "[0-9]+", "#"), "event_id").select("event_id", "kind")


@query("x7_rare_key_sets", f"WITH {SPANS}, k AS (SELECT span_id, CASE WHEN duration_ms > 4900 THEN 'service,slow' ELSE 'service' END AS keys FROM spans) SELECT span_id, keys FROM k WHERE keys = 'service,slow' AND (SELECT count(*) FROM k WHERE keys = 'service,slow') < 0.01 * (SELECT count(*) FROM k)")
def _(spark, sf):
    df = spans(spark, sf).withColumn("attributes", F.map_filter(F.create_map(F.lit("service"), "service", F.lit("slow"), F.when(F.col("duration_ms") > 4900, "y")), lambda k, v: v.isNotNull()))
    return X.rare_key_sets(df, "attributes", "span_id")


@query("x8_u1_combined", f"""WITH {LOGS}, a AS (SELECT event_id, ts, message, {_T} AS t FROM logs), s AS (SELECT avg(length(message)) AS m, stddev_pop(length(message)) AS sd FROM a) SELECT event_id, 'unusual_length' AS kind FROM a, s WHERE abs(length(message) - m) > 2 * sd""")
def _(spark, sf):
    found = X.message_anomalies(logs(spark, sf), F.regexp_replace("message", "[0-9]+", "#"), "event_id", 0.0)
    return X.combine(found, found.withColumn("score", F.col("score") / 2)).select("event_id", "kind")


@query("x10_x13_trace_anomalies", f"""WITH {SPANS}, t AS (SELECT trace_id, count(*) AS n, count(*) FILTER (WHERE is_error) AS e FROM spans GROUP BY trace_id), c AS (SELECT n, count(*) / CAST((SELECT count(*) FROM t) AS DOUBLE) AS share FROM t GROUP BY n)
SELECT trace_id, 'error' AS kind, round(least(2.0 * e / n, 1.0), 6) AS score FROM t WHERE e > 0 UNION ALL SELECT trace_id, 'span_count', round(1 - share, 6) FROM t JOIN c USING (n) WHERE share < 0.05""")
def _(spark, sf):
    t = N.trace_table(spans(spark, sf))
    return rounded(X.trace_errors(t).unionByName(X.trace_sizes(t)), "score", digits=6)


@query("x10_trace_latency", f"WITH {SPANS}, c AS (SELECT operation, quantile_disc(duration_ms, 0.95) AS p FROM spans WHERE line = 0 GROUP BY operation HAVING count(*) >= 5) SELECT trace_id, 'latency' AS kind, round(least((duration_ms / p - 1) / 2, 1.0), 6) AS score FROM spans JOIN c USING (operation) WHERE line = 0 AND duration_ms > p")
def _(spark, sf):
    return rounded(X.trace_latency(N.trace_table(spans(spark, sf))), "score", digits=6)


@query("x14_span_anomalies", f"""WITH {SPANS}, z AS (SELECT s.*, (duration_ms - avg(duration_ms) OVER w) / nullif(stddev_pop(duration_ms) OVER w, 0) AS z FROM spans s WINDOW w AS (PARTITION BY trace_id)), k AS (SELECT z.trace_id, z.span_id, CASE WHEN z.z > 3 THEN 'duration' WHEN z.is_error THEN 'error' WHEN z.parent_span_id IS NOT NULL AND p.span_id IS NULL THEN 'missing_parent' END AS kind FROM z LEFT JOIN spans p ON p.trace_id = z.trace_id AND p.span_id = z.parent_span_id) SELECT * FROM k WHERE kind IS NOT NULL""")
def _(spark, sf):
    return X.span_anomalies(spans(spark, sf)).select("trace_id", "span_id", "kind")


_CLS = f"""WITH {SPANS}, c AS (SELECT quantile_disc(duration_ms, 0.95) AS p FROM spans), r AS (SELECT span_id, service, start_ts, duration_ms, is_error, CASE WHEN contains(lower(concat_ws(' ', error_type, operation)), 'timeout') OR duration_ms > 30000 THEN 'timeout' WHEN contains(lower(concat_ws(' ', error_type, operation)), 'connection') THEN 'connection' WHEN contains(lower(concat_ws(' ', error_type, operation)), 'memory') THEN 'memory' WHEN duration_ms >= p THEN 'high_latency' ELSE 'unknown' END AS kind FROM spans, c WHERE duration_ms >= p OR is_error)"""


_SURE = "CASE kind WHEN 'timeout' THEN 0.9 WHEN 'connection' THEN 0.85 WHEN 'memory' THEN 0.9 WHEN 'high_latency' THEN 0.6 ELSE 0.5 END"


@query("x15_trace_classes", _CLS.replace("is_error, CASE", "is_error, operation, CASE", 1) + f""", v AS (SELECT *, CAST({_SURE} AS DOUBLE) AS confidence, least(10.0, {_SURE} * 3 + CASE WHEN duration_ms > 10000 THEN 3 WHEN duration_ms > 5000 THEN 2 ELSE 0 END + CASE WHEN is_error THEN 2 ELSE 0 END + CASE WHEN kind = 'memory' THEN 3 WHEN kind IN ('timeout', 'connection') THEN 2 ELSE 0 END) AS score FROM r)
SELECT span_id, kind, confidence, round(score, 4) AS score, CASE WHEN score >= 8 THEN 'critical' WHEN score >= 6 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS level, duration_ms, CASE WHEN is_error THEN 'ERROR' ELSE 'OK' END AS status, operation FROM v""")
def _(spark, sf):
    out = X.classify_traces(spans(spark, sf))
    return rounded(out.select("span_id", "kind", "confidence", "score", "level", "evidence.*"), "score")


@query("x17_patterns", _CLS + " SELECT 'kind' AS by, kind AS value, count(*) AS count FROM r GROUP BY kind HAVING count(*) >= 3 UNION ALL SELECT 'service', service, count(*) FROM r GROUP BY service HAVING count(*) >= 5")
def _(spark, sf):
    return X.anomaly_patterns(X.classify_traces(spans(spark, sf))).select("by", "value", "count")


@query("x16_cp22_priority", _CLS + """, cc AS (SELECT *, CASE kind WHEN 'timeout' THEN 0.9 WHEN 'connection' THEN 0.85 WHEN 'memory' THEN 0.9 WHEN 'high_latency' THEN 0.6 ELSE 0.5 END * 3 + CASE WHEN duration_ms > 10000 THEN 3 WHEN duration_ms > 5000 THEN 2 ELSE 0 END + CASE WHEN is_error THEN 2 ELSE 0 END + CASE WHEN kind = 'memory' THEN 3 WHEN kind IN ('timeout', 'connection') THEN 2 ELSE 0 END AS s FROM r),
n AS (SELECT count(*) FILTER (WHERE s >= 8) AS critical, count(*) FILTER (WHERE s >= 6 AND s < 8) AS high, count(*) FILTER (WHERE s >= 4 AND s < 6) AS medium, count(*) FILTER (WHERE s < 4) AS low FROM cc) SELECT *, CASE WHEN critical > 0 THEN 'immediate' WHEN high > 2 THEN 'high' WHEN high > 0 OR medium > 5 THEN 'medium' ELSE 'low' END AS priority FROM n""")
def _(spark, sf):
    return X.priority(X.classify_traces(spans(spark, sf)))


@query("x18_last_value", f"WITH {S1}, l AS (SELECT metric, max(i) AS z FROM s GROUP BY metric), b AS (SELECT s.metric, avg(value) AS m, stddev_pop(value) AS sd FROM s JOIN l USING (metric) WHERE i <= z - 2 GROUP BY 1) SELECT s.metric, round(least(1.0, greatest(0.0, (value - m) / sd) / 3), 6) AS signal FROM s JOIN l USING (metric) JOIN b USING (metric) WHERE i = z")
def _(spark, sf):
    return rounded(X.last_value_signal(daily(spark, sf), M).select("metric", "signal"), "signal", digits=6)


@query("x19_bursts", f"WITH {S6}, z AS (SELECT metric, i, (value - avg(value) OVER (PARTITION BY metric)) / stddev_pop(value) OVER (PARTITION BY metric) AS z FROM s) SELECT metric, i, CASE WHEN z > 3 THEN 'high' ELSE 'medium' END AS level FROM z WHERE z > 2")
def _(spark, sf):
    return X.bursts(six_hours(spark, sf), M).select("metric", "i", "level")
