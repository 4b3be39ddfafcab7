"""Anomaly operators on series, spans, logs and feature vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.lineage import cut_lineage
from tracelake.functions.stats import interpolated_percentiles, rank_percentiles, ratio, value_counts
from tracelake.operators.density import density_clusters
from tracelake.operators.series import seasonal_adjust
from tracelake.shipping import ship


def z_anomalies(series: DataFrame, keys: Sequence[str], sensitivity: float = 0.5) -> DataFrame:
    """|z| above 3 - 2 s; score min(z / 2t, 1); spike or dip."""
    t = 3 - 2 * sensitivity
    g = Window.partitionBy(*keys)
    z = ratio(F.col("value") - F.avg("value").over(g), F.stddev_pop("value").over(g))
    return series.withColumn("z", z).filter(F.abs("z") > t).withColumn("score", F.least(F.abs("z") / (2 * t), F.lit(1.0))).withColumn("kind", F.when(F.col("z") > 0, "spike").otherwise("dip"))


def _upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.join(rank_percentiles(df, keys, value, {name: 0.5}, "floor"), list(keys))


def mad_anomalies(series: DataFrame, keys: Sequence[str], sensitivity: float = 0.5) -> DataFrame:
    """0.6745 (x - median) / MAD beyond 3.5 - 2 s; none where MAD is 0."""
    t = 3.5 - 2 * sensitivity
    rows = _upper_median(series, keys, "value", "_med").withColumn("_dev", F.abs(F.col("value") - F.col("_med")))
    rows = _upper_median(rows, keys, "_dev", "_mad")
    z = F.try_divide(0.6745 * (F.col("value") - F.col("_med")), F.col("_mad"))
    return rows.withColumn("z", z).filter(F.abs("z") > t).withColumn("score", F.least(F.abs("z") / (2 * t), F.lit(1.0))).withColumn("kind", F.when(F.col("z") > 0, "spike").otherwise("dip")).drop("_med", "_dev", "_mad")


def percentile_anomalies(series: DataFrame, keys: Sequence[str], sensitivity: float = 0.9) -> DataFrame:
    """Values outside the central band; score by the distance of their rank from it."""
    p = (1 - sensitivity) / 2
    band = series.groupBy(*keys).agg(F.percentile("value", F.lit(p)).alias("_lo"), F.percentile("value", F.lit(1 - p)).alias("_hi"))
    rank = F.percent_rank().over(Window.partitionBy(*keys).orderBy("value"))
    rows = series.withColumn("rank", rank).join(band, list(keys))
    out = rows.filter((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi")))
    return out.withColumn("kind", F.when(F.col("value") > F.col("_hi"), "spike").otherwise("dip")).withColumn("score", F.when(F.col("kind") == "spike", (F.col("rank") - (1 - p)) / p).otherwise((p - F.col("rank")) / p)).drop("_lo", "_hi")


def isolation_window(series: DataFrame, keys: Sequence[str], w: int = 5, sensitivity: float = 0.5) -> DataFrame:
    """Mean over largest distance to the values within ±w above 1 - s."""
    frame = Window.partitionBy(*keys).orderBy("i").rowsBetween(-w, w)
    rows = series.withColumn("_v", F.collect_list("value").over(frame))
    d = F.transform("_v", lambda x: F.abs(x - F.col("value")))
    score = ratio(F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / (F.size(d) - 1), F.array_max(d))
    return rows.withColumn("score", score).filter(F.col("score") > 1 - sensitivity).drop("_v")


METHODS = {"zscore": z_anomalies, "mad": mad_anomalies, "percentile": percentile_anomalies, "isolation": isolation_window}


def detect_anomalies(series: DataFrame, keys: Sequence[str], method: str = "zscore", sensitivity: float = 0.5, period: int | None = None, least: int = 30) -> DataFrame:
    """One detector over all series with at least ``least`` points, adjusted for a season if given."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = series.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")
    if period:
        rows = seasonal_adjust(rows, keys, period).withColumn("value", F.col("adjusted")).drop("adjusted")
    if method == "isolation":
        return isolation_window(rows, keys, sensitivity=sensitivity)
    return METHODS[method](rows, keys, sensitivity)


def anomaly_rate_change(current: DataFrame, baseline: DataFrame, n_current: int, n_baseline: int) -> DataFrame:
    """Anomaly kinds in both periods or new, and whether the rate moved by over 0.1."""
    c, b = current.groupBy("kind").agg(F.count("*").alias("current")), baseline.groupBy("kind").agg(F.count("*").alias("baseline"))
    j = c.join(b, "kind", "full_outer").fillna(0)
    change = F.sum("current").over(Window.partitionBy(F.lit(0))) / n_current - F.sum("baseline").over(Window.partitionBy(F.lit(0))) / n_baseline
    return j.withColumn("state", F.when(F.col("baseline") == 0, "new").when(F.col("current") == 0, "gone").otherwise("common")).withColumn("rate_change", change).withColumn("significant", F.abs(change) > 0.1)


def threshold_anomalies(series: DataFrame, keys: Sequence[str], sensitivity: float = 0.5) -> DataFrame:
    """Deviation above std (1 + 3 (1 - s)); score min(deviation in std / 3, 1)."""
    g = Window.partitionBy(*keys)
    rows = series.withColumn("_m", F.avg("value").over(g)).withColumn("_s", F.stddev_pop("value").over(g))
    dev = F.abs(F.col("value") - F.col("_m"))
    return rows.filter(dev > F.col("_s") * (1 + 3 * (1 - sensitivity))).withColumn("score", F.least(ratio(dev, F.col("_s")) / 3, F.lit(1.0))).drop("_m", "_s")


def rolling_anomalies(series: DataFrame, keys: Sequence[str], frame: int = 5, t: float = 3.0) -> DataFrame:
    """|z| > 3 against the previous ``frame`` values."""
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(-frame, -1)
    rows = series.withColumn("_m", F.avg("value").over(w)).withColumn("_s", F.stddev_pop("value").over(w)).withColumn("_n", F.count("value").over(w))
    return rows.withColumn("z", F.try_divide(F.col("value") - F.col("_m"), F.col("_s"))).filter((F.col("_n") == frame) & (F.abs("z") > t)).drop("_m", "_s", "_n")


def last_value_signal(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last value against all but the last two: min(1, z / 3)."""
    n = F.max("i").over(Window.partitionBy(*keys))
    rows = series.withColumn("_last", n)
    base = rows.filter(F.col("i") <= F.col("_last") - 2).groupBy(*keys).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    last = rows.filter(F.col("i") == F.col("_last")).select(*keys, "value")
    return last.join(base, list(keys)).withColumn("signal", F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio(F.col("value") - F.col("m"), F.col("s"))) / 3))


def bursts(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Above mean + 2 std; high above 3 std."""
    g = Window.partitionBy(*keys)
    z = ratio(F.col("value") - F.avg("value").over(g), F.stddev_pop("value").over(g))
    return series.withColumn("z", z).filter("z > 2").withColumn("level", F.when(F.col("z") > 3, "high").otherwise("medium"))


def _joined(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by group; without groups ``b`` is one row."""
    return a.join(b, list(by), how) if by else a.join(F.broadcast(b), how=how)


def robust_scores(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), least: int = 20) -> DataFrame:
    """Largest absolute modified z over the features, within groups of at least ``least`` rows."""
    found = None
    for f in features:  # distances are counted from the counts of values; the rows are read once a feature and once for the result
        counts = value_counts(df, by, f)
        size = counts.groupBy(*by).agg(F.sum("_n").alias("_rows"))
        middle = interpolated_percentiles(counts, by, f, {f"_m_{f}": 0.5}, counted=True)
        away = _joined(counts, middle, by).groupBy(*by, F.abs(F.col(f) - F.col(f"_m_{f}")).alias("_d")).agg(F.sum("_n").alias("_n"))
        spread = interpolated_percentiles(cut_lineage(away), by, "_d", {f"_a_{f}": 0.5}, counted=True)
        per = _joined(_joined(size, middle, by, "left"), spread, by, "left")
        found = per if found is None else _joined(found, per.drop("_rows"), by)
    # a row a group, and its size is known: it goes to every task if it is small
    rows = _joined(df, cut_lineage(found.filter(F.col("_rows") >= least).drop("_rows")), by)
    rows = rows.withColumns({f"_d_{f}": F.abs(F.col(f) - F.col(f"_m_{f}")) for f in features})
    parts = [ratio(0.6745 * F.col(f"_d_{f}"), F.col(f"_a_{f}")) for f in features]
    score = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return rows.withColumn("score", score).drop(*[f"_{k}_{f}" for k in "mda" for f in features])


def pca_scores(df: DataFrame, features: Sequence[str], k: int = 2) -> DataFrame:
    """Reconstruction error after a PCA of the standardised features."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df)
    scaled = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_z", outputCol="_p").fit(scaled)
    out = model.transform(scaled)
    z, p = vector_to_array("_z"), vector_to_array("_p")
    norm = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)  # noqa: E731  the components are orthonormal
    return out.withColumn("score", F.sqrt(F.greatest(F.lit(0.0), norm(z) - norm(p)))).drop("_x", "_z", "_p")


def isolation_forest(df: DataFrame, features: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 7) -> DataFrame:
    """Isolation-forest score 2^(-E(h)/c(n)): trees grow on hash samples of at most ``sample`` rows, scoring runs in Arrow batches."""
    import numpy as np
    import pandas as pd

    ship(df.sparkSession)
    need = trees * sample  # the only rows that reach the driver
    pool = df.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna().orderBy(F.xxhash64(*features, F.lit(seed))).limit(need).toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    m = min(sample, len(pool))
    depth = int(np.ceil(np.log2(max(m, 2))))
    c = lambda n: 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(x, d):
        if d >= depth or len(x) < 2:
            return d + c(len(x))
        f = int(rng.integers(x.shape[1]))
        lo, hi = x[:, f].min(), x[:, f].max()
        if lo == hi:
            return d + c(len(x))
        cut = rng.uniform(lo, hi)
        return (f, cut, grow(x[x[:, f] < cut], d + 1), grow(x[x[:, f] >= cut], d + 1))

    forest = df.sparkSession.sparkContext.broadcast([grow(pool[rng.choice(len(pool), m, replace=False)], 0) for _ in range(trees)] if m else [])
    scale = max(c(m), 1e-9)

    def length(x, node, out, at):
        if not isinstance(node, tuple):
            out[at] += node
            return
        f, cut, a, b = node
        left = x[at, f] < cut
        length(x, a, out, at[left])
        length(x, b, out, at[~left])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[list(features)].to_numpy(dtype=float)
            out = np.zeros(len(x))
            for t in forest.value:
                length(x, t, out, np.arange(len(x)))
            b["score"] = 2.0 ** (-(out / max(len(forest.value), 1)) / scale)
            yield b

    from pyspark.sql import types as T

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


def random_cut_forest(df: DataFrame, features: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 7) -> DataFrame:
    """Expected collusive displacement of each row in random cut trees: how many points a point must move to hide among them.

    Trees grow on hash samples of at most ``sample`` rows, as for the isolation forest; they cut a
    bounding box at a place drawn from all its sides together. A row is not inserted: at a node
    whose box it would widen by e on a total of s, a cut parts it with probability e / (e + s), and
    then the node's points are displaced; otherwise it goes down, and what it would displace along
    with the points of that side counts as well. Rows with a null feature get null.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    ship(df.sparkSession)
    pool = df.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna().orderBy(F.xxhash64(*features, F.lit(seed))).limit(trees * sample).toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    m = min(sample, len(pool))
    forest = df.sparkSession.sparkContext.broadcast([cut_tree(pool[rng.choice(len(pool), m, replace=False)], rng) for _ in range(trees)] if m else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[list(features)].to_numpy(dtype=float)
            known = ~np.isnan(x).any(axis=1)
            score = np.full(len(x), np.nan)
            score[known] = sum((displacement(x[known], t) for t in forest.value), np.zeros(int(known.sum()))) / max(len(forest.value), 1)
            b["score"] = pd.Series(score, index=b.index).astype(object).where(known, None)
            yield b

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


def cut_tree(x, rng) -> tuple:
    """(size, low corner, high corner, feature, cut, left, right); a leaf, one point however often, has no feature."""
    low, high = x.min(axis=0), x.max(axis=0)
    sides = high - low
    if not sides.sum() > 0:
        return (len(x), low, high, None, None, None, None)
    at = rng.uniform(0, sides.sum())
    f = min(int((sides.cumsum() <= at).sum()), len(sides) - 1)
    cut = low[f] + (at - (sides[:f].sum() if f else 0.0))
    left = x[:, f] <= cut
    if left.all() or not left.any():  # a cut on the edge itself
        cut = (low[f] + high[f]) / 2
        left = x[:, f] <= cut
    return (len(x), low, high, f, cut, cut_tree(x[left], rng), cut_tree(x[~left], rng))


def displacement(x, tree: tuple):
    """Expected collusive displacement of each row of ``x``, in one walk for all rows."""
    import numpy as np

    out = np.zeros(len(x))
    todo = [(tree, np.arange(len(x)), np.ones(len(x)), np.zeros(len(x)))]
    while todo:
        (n, low, high, f, cut, left, right), at, reach, best = todo.pop()
        wider = (np.maximum(low - x[at], 0) + np.maximum(x[at] - high, 0)).sum(axis=1)
        total = wider + (high - low).sum()
        parted = np.divide(wider, total, out=np.zeros(len(at)), where=total > 0)
        out[at] += reach * parted * np.maximum(best, n)
        reach = reach * (1 - parted)
        if f is None:
            out[at] += reach * best  # the same point again
            continue
        small = x[at, f] <= cut
        for side, other, here in ((left, right, small), (right, left, ~small)):
            if here.any():
                todo.append((side, at[here], reach[here], np.maximum(best[here], other[0] / (side[0] + 1))))
    return out


def outlier_scores(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), method: str = "robust") -> DataFrame:
    return {"robust": lambda: robust_scores(df, features, by), "pca": lambda: pca_scores(df, features), "iforest": lambda: isolation_forest(df, features), "rcf": lambda: random_cut_forest(df, features)}[method]()


def density_noise(df: DataFrame, key: str, x: str, y: str, eps: float = 0.5, min_points: int = 5, rounds: int = 200) -> DataFrame:
    """key, cluster (smallest core key; null for noise) by two columns, see ``density_clusters``."""
    return density_clusters(df, key, [x, y], eps, min_points, rounds)


def volume_anomalies(logs: DataFrame, seconds: int = 60, t: float = 3.0) -> DataFrame:
    """Buckets whose log volume has z > t, with the middle log of the bucket as its example."""
    from tracelake.functions.timeutil import bucket

    rows = logs.withColumn("bucket", bucket(F.col("ts"), seconds))
    per = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    stats = F.broadcast(per.agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("s")))
    odd = per.crossJoin(stats).withColumn("z", ratio(F.col("n") - F.col("m"), F.col("s"))).filter(F.col("z") > t)
    middle = rows.join(F.broadcast(odd.select("bucket")), "bucket").withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("ts", "message")))
    middle = middle.join(F.broadcast(odd.select("bucket", "n", "z")), "bucket").filter(F.col("r") == F.floor(F.col("n") / 2) + 1)
    return middle.select("bucket", "n", "z", "message")


def volume_spikes(logs: DataFrame, seconds: int = 300, times: float = 2.0) -> DataFrame:
    """Buckets above ``times`` the mean volume, with their levels."""
    from tracelake.functions.timeutil import bucket

    per = logs.groupBy(bucket(F.col("ts"), seconds).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.lower("level") == "error").alias("errors"), F.count_if(F.lower("level") == "warn").alias("warnings"))
    mean = F.broadcast(per.agg(F.avg("n").alias("m")))
    return per.crossJoin(mean).filter(F.col("n") > times * F.col("m")).drop("m")


def message_anomalies(logs: DataFrame, template: Column, key: str, rare: float = 0.01) -> DataFrame:
    """Logs of rare templates, and logs whose length is over 2 std from the mean (score min(d / 3 std, 1))."""
    rows = logs.select(key, "ts", "message", template.alias("template"))
    share = rows.groupBy("template").agg(F.count("*").alias("_n"))
    total = F.broadcast(rows.agg(F.count("*").alias("_all"), F.avg(F.length("message")).alias("_m"), F.stddev_pop(F.length("message")).alias("_s")))
    rows = rows.join(share, "template").crossJoin(total)
    part = ratio(F.col("_n"), F.col("_all"))
    dev = F.abs(F.length("message") - F.col("_m"))
    is_rare, is_long = part < rare, dev > 2 * F.col("_s")
    return rows.filter(is_rare | is_long).select(key, "ts", "message", F.when(is_rare, "rare_pattern").otherwise("unusual_length").alias("kind"), F.when(is_rare, 1 - part).otherwise(F.least(ratio(dev, F.col("_s")) / 3, F.lit(1.0))).alias("score"))


def rare_key_sets(df: DataFrame, attributes: str, key: str, share: float = 0.01) -> DataFrame:
    """Rows whose set of attribute keys is rarer than ``share``."""
    rows = df.select(key, F.array_join(F.array_sort(F.map_keys(attributes)), ",").alias("keys"))
    per = rows.groupBy("keys").agg(F.count("*").alias("_n"))
    total = F.broadcast(rows.agg(F.count("*").alias("_all")))
    return rows.join(per.crossJoin(total).filter(F.col("_n") < share * F.col("_all")).select("keys"), "keys")


def combine(*found: DataFrame) -> DataFrame:
    """Union of detectors' rows (key, ts, message, kind, score); of equal ts and message the highest score stays."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    w = Window.partitionBy("ts", "message").orderBy(F.desc("score"), "kind")
    return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def trace_latency(traces: DataFrame, p: float = 0.95, least: int = 5) -> DataFrame:
    """Traces above their root's percentile (roots with enough traces); score min((d/p - 1)/2, 1)."""
    keys = ["root_service", "root_operation"]
    cut = rank_percentiles(traces, keys, "root_ms", {"_p": p}).join(traces.groupBy(*keys).agg(F.count("*").alias("_n")), keys).filter(F.col("_n") >= least)
    over = traces.join(cut, keys).filter(F.col("root_ms") > F.col("_p"))
    return over.select("trace_id", F.lit("latency").alias("kind"), F.least((ratio(F.col("root_ms"), F.col("_p")) - 1) / 2, F.lit(1.0)).alias("score"))


def trace_errors(traces: DataFrame) -> DataFrame:
    return traces.filter("error_count > 0").select("trace_id", F.lit("error").alias("kind"), F.least(2 * ratio(F.col("error_count"), F.col("span_count")), F.lit(1.0)).alias("score"))


def trace_sizes(traces: DataFrame, share: float = 0.05) -> DataFrame:
    """Traces whose number of spans is rare."""
    per = traces.groupBy("span_count").agg(F.count("*").alias("_n"))
    total = F.broadcast(traces.agg(F.count("*").alias("_all")))
    odd = per.crossJoin(total).withColumn("_s", ratio(F.col("_n"), F.col("_all"))).filter(F.col("_s") < share)
    return traces.join(F.broadcast(odd.select("span_count", "_s")), "span_count").select("trace_id", F.lit("span_count").alias("kind"), (1 - F.col("_s")).alias("score"))


def span_anomalies(spans: DataFrame) -> DataFrame:
    """Within each trace: duration z > 3, errors (.8), parents that the trace doesn't have (.7)."""
    g = Window.partitionBy("trace_id")
    z = ratio(F.col("duration_ms") - F.avg("duration_ms").over(g), F.stddev_pop("duration_ms").over(g))
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_p")).distinct()
    rows = spans.withColumn("_z", z).join(parents, ["trace_id", "parent_span_id"], "left")
    kind = F.when(F.col("_z") > 3, "duration").when(F.col("is_error"), "error").when(F.col("parent_span_id").isNotNull() & F.col("_p").isNull(), "missing_parent")
    score = F.when(F.col("_z") > 3, F.least(F.col("_z") / 6, F.lit(1.0))).when(F.col("is_error"), 0.8).otherwise(0.7)
    return rows.withColumn("kind", kind).filter("kind is not null").select("trace_id", "span_id", "kind", score.alias("score"))


def classify_traces(spans: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Slow or failing spans with the first rule that fits, its confidence, severity score and level."""
    cut = F.broadcast(rank_percentiles(spans, [], "duration_ms", {"_p": {"low": 0.99, "medium": 0.95, "high": 0.9}[sensitivity]}))
    rows = spans.crossJoin(cut).filter((F.col("duration_ms") >= F.col("_p")) | F.col("is_error"))
    text = F.lower(F.concat_ws(" ", "error_type", "operation"))
    rules = [
        ("timeout", F.contains(text, F.lit("timeout")) | (F.col("duration_ms") > 30000), 0.9), ("circuit_breaker", F.contains(text, F.lit("circuit")), 0.95), ("database_slow", F.contains(text, F.lit("db")) & (F.col("duration_ms") > 5000), 0.8),
        ("connection", F.contains(text, F.lit("connection")), 0.85), ("memory", F.contains(text, F.lit("memory")), 0.9), ("retry", F.contains(text, F.lit("retry")), 0.7), ("high_latency", F.col("duration_ms") >= F.col("_p"), 0.6),
    ]
    kind = confidence = None
    for name, test, value in rules:
        test = F.coalesce(test, F.lit(False))
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        confidence = F.when(test, value) if confidence is None else confidence.when(test, value)
    rows = rows.withColumn("kind", kind.otherwise("unknown")).withColumn("confidence", confidence.otherwise(0.5))
    weight = F.when(F.col("kind").isin("circuit_breaker", "memory"), 3).when(F.col("kind").isin("timeout", "connection"), 2).otherwise(0)
    score = F.least(F.lit(10.0), F.col("confidence") * 3 + F.when(F.col("duration_ms") > 10000, 3).when(F.col("duration_ms") > 5000, 2).otherwise(0) + F.when(F.col("is_error"), 2).otherwise(0) + weight)
    level = F.when(score >= 8, "critical").when(score >= 6, "high").when(score >= 4, "medium").otherwise("low")
    evidence = F.struct(F.col("duration_ms"), F.when(F.col("is_error"), "ERROR").otherwise("OK").alias("status"), F.substring("operation", 1, 100).alias("operation"))
    return rows.select("trace_id", "span_id", "service", "start_ts", "kind", "confidence", score.alias("score"), level.alias("level"), evidence.alias("evidence"))


def anomaly_patterns(classified: DataFrame, per_kind: int = 3, per_service: int = 5) -> DataFrame:
    """Kinds and services with enough anomalies, and how close in time they lie."""
    rows = classified.select(F.explode(F.array(F.struct(F.lit("kind").alias("by"), F.col("kind").alias("value")), F.struct(F.lit("service").alias("by"), F.col("service").alias("value")))).alias("k"), "start_ts")
    span = (F.unix_micros(F.max("start_ts").cast("timestamp")) - F.unix_micros(F.min("start_ts").cast("timestamp"))) / 1e6
    out = rows.groupBy("k.by", "k.value").agg(F.count("*").alias("count"), span.alias("_s"))
    out = out.filter(((F.col("by") == "kind") & (F.col("count") >= per_kind)) | ((F.col("by") == "service") & (F.col("count") >= per_service)))
    return out.select("by", "value", "count", F.when(F.col("_s") < 60, "burst").when(F.col("_s") < 300, "cascade").otherwise("distributed").alias("timing"))


def priority(classified: DataFrame) -> DataFrame:
    """Overall priority from the severity counts."""
    n = classified.agg(*[F.count_if(F.col("level") == k).alias(k) for k in ("critical", "high", "medium", "low")])
    return n.withColumn("priority", F.when(F.col("critical") > 0, "immediate").when(F.col("high") > 2, "high").when((F.col("high") > 0) | (F.col("medium") > 5), "medium").otherwise("low"))
