"""Log text operators: templates, period change, co-occurrence, transactions, itemsets, sequences, phrases."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.functions.lineage import cut_lineage
from tracelake.functions.phrases import LENGTHS, counters, phrases_on
from tracelake.functions.stats import ratio
from tracelake.functions.timeutil import bucket

# fixed values: words that carry no topic
STOP = tuple("the a an and or but in on at to for of with by from is are was were be been has have had it its this that these those as not no".split())
# fixed values: words that tell a language
LANGUAGE_WORDS = {"en": "the and of to in is that it was for", "es": "el la de que y en los se del las", "fr": "le la les de des et un une dans que", "de": "der die und das ist nicht ein eine zu den"}


def log_templates(logs: DataFrame, template: Column, least: int = 2, most: int = 100, examples: int = 5) -> DataFrame:
    """Templates with count, share, services, levels and an example; the commonest first."""
    rows = logs.withColumn("template", template)
    per = rows.groupBy("template").agg(F.count("*").alias("count"), F.sort_array(F.collect_set("service")).alias("services"), F.sort_array(F.collect_set("level")).alias("levels"), F.min("message").alias("example"))
    total = F.broadcast(logs.agg(F.count("*").alias("_all")))
    return per.filter(F.col("count") >= least).crossJoin(total).select("template", "count", ratio(F.col("count"), F.col("_all")).alias("share"), "services", "levels", "example").orderBy(F.desc("count"), "template").limit(most)


def template_changes(current: DataFrame, baseline: DataFrame, template: Column, least: float = 0.2) -> DataFrame:
    """new / missing / frequency change of template shares, with significance."""
    share = lambda d, n: d.groupBy(template.alias("template")).agg(F.count("*").alias("_c")).crossJoin(F.broadcast(d.agg(F.count("*").alias("_a")))).select("template", ratio(F.col("_c"), F.col("_a")).alias(n))
    j = share(current, "current").join(share(baseline, "baseline"), "template", "full_outer")
    change = ratio(F.col("current") - F.col("baseline"), F.col("baseline"))
    kind = F.when(F.col("baseline").isNull(), "new").when(F.col("current").isNull(), "missing").when(F.abs(change) > least, "frequency")
    top = F.greatest(F.coalesce("current", F.lit(0.0)), F.coalesce("baseline", F.lit(0.0)))
    high = (F.abs(change) > 0.5) | (top > 0.1)
    medium = (F.abs(change) > 0.25) | (top > 0.05)
    return j.withColumn("kind", kind).filter("kind is not null").select("template", "kind", "current", "baseline", F.when(high, "high").when(medium, "medium").otherwise("low").alias("significance"))


def families(template: Column) -> Column:
    """The family of the first word that names one, else the first word of over three letters."""
    groups = {"Errors": "error exception fail failed failure", "Lifecycle start": "start started starting boot init", "Lifecycle end": "stop stopped shutdown exit terminated", "HTTP": "http get post put request response", "Database": "sql query database db select insert", "Cache": "cache redis hit miss", "Authentication": "auth login logout token password"}
    words = F.filter(F.split(F.lower(template), "[^a-z]+"), lambda w: w != "")
    named = F.lit(None).cast("string")
    which = lambda w: F.coalesce(*[F.when(w.isin(v.split()), k) for k, v in groups.items()], named)
    found = F.filter(F.transform(words, which), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.get(F.filter(words, lambda w: F.length(w) > 3), F.lit(0)), F.lit("Other"))


def cooccurrence(logs: DataFrame, template: Column, seconds: int = 60, least: float = 0.7) -> DataFrame:
    """Jaccard of the windows in which two templates occur."""
    rows = logs.select(template.alias("t"), bucket(F.col("ts"), seconds).alias("w")).distinct()
    n = rows.groupBy("t").agg(F.count("*").alias("n"))
    a, b = rows.select(F.col("t").alias("a"), "w"), rows.select(F.col("t").alias("b"), "w")
    both = a.join(b, "w").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = both.join(n.select(F.col("t").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("t").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "both", ratio(F.col("both"), F.col("na") + F.col("nb") - F.col("both")).alias("jaccard")).filter(F.col("jaccard") >= least)


def transactions(logs: DataFrame, key: str) -> DataFrame:
    """Per log the distinct items: level, service, keywords."""
    items = F.array_distinct(F.concat(F.array(F.concat(F.lit("level:"), "level"), F.concat(F.lit("service:"), "service")), F.transform(C.keywords(F.col("message")), lambda k: F.concat(F.lit("kw:"), k))))
    return logs.select(key, items.alias("items"))


def itemsets(trans: DataFrame, support: float = 0.01, most: int = 5) -> DataFrame:
    """Frequent itemsets of at most ``most`` items: items (sorted), count, support."""
    from pyspark.ml.fpm import FPGrowth

    total = F.broadcast(trans.agg(F.count("*").alias("_all")))
    found = FPGrowth(itemsCol="items", minSupport=support).fit(trans).freqItemsets.filter(F.size("items") <= most)
    return found.crossJoin(total).select(F.array_join(F.array_sort("items"), "|").alias("items"), F.col("freq").alias("count"), ratio(F.col("freq"), F.col("_all")).alias("support"))


def association_rules(sets: DataFrame, confidence: float = 0.5) -> DataFrame:
    """All splits of an itemset into antecedent and consequent, with confidence and lift."""
    s = sets.withColumn("a", F.split("items", r"\|")).filter(F.size("a") > 1)
    masks = F.explode(F.sequence(F.lit(1), (F.shiftleft(F.lit(1), 5) - 2)))
    rows = s.select("items", "a", "count", "support", masks.alias("m")).filter(F.col("m") < F.pow(F.lit(2), F.size("a")) - 1)
    # position p of the sorted items belongs to the antecedent where bit p of m is set
    pick = lambda want: F.array_join(F.filter("a", lambda x, p: (F.floor(F.col("m") / F.pow(F.lit(2), p)) % 2) == want), "|")
    rows = rows.select("count", "support", pick(1).alias("antecedent"), pick(0).alias("consequent"))
    one = sets.select(F.col("items").alias("antecedent"), F.col("count").alias("ca"))
    two = sets.select(F.col("items").alias("consequent"), F.col("support").alias("sc"))
    out = rows.join(one, "antecedent").join(two, "consequent").withColumn("confidence", ratio(F.col("count"), F.col("ca")))
    return out.filter(F.col("confidence") >= confidence).select("antecedent", "consequent", "support", "confidence", ratio(F.col("confidence"), F.col("sc")).alias("lift"))


def sequence_pairs(events: DataFrame, key: Sequence[str], item: str, ts: str, support: float = 0.01) -> DataFrame:
    """Ordered pairs of different items within a sequence: sequences that hold them, and the mean gap of first occurrences."""
    first = events.groupBy(*key, item).agg(F.min(ts).alias("f"), F.max(ts).alias("l"))
    a = first.select(*key, F.col(item).alias("a"), F.col("f").alias("fa"))
    b = first.select(*key, F.col(item).alias("b"), F.col("l").alias("lb"), F.col("f").alias("fb"))
    n = F.broadcast(events.select(*key).distinct().agg(F.count("*").alias("_n")))
    gap = F.when(F.col("fb") > F.col("fa"), F.unix_micros(F.col("fb").cast("timestamp")) - F.unix_micros(F.col("fa").cast("timestamp"))) / 1e6
    pairs = a.join(b, list(key)).filter((F.col("a") != F.col("b")) & (F.col("lb") > F.col("fa")))
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("count"), F.avg(gap).alias("gap_s")).crossJoin(n)
    return out.withColumn("support", ratio(F.col("count"), F.col("_n"))).filter(F.col("support") >= support).drop("_n")


def prefix_sequences(events: DataFrame, key: Sequence[str], item: str, ts: str, support: float = 0.2, length: int = 3) -> DataFrame:
    """Longer sequences by PrefixSpan; a key's items in time order."""
    from pyspark.ml.fpm import PrefixSpan

    ordered = events.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(ts, item))), lambda x: F.array(x[item])).alias("sequence"))
    found = PrefixSpan(minSupport=support, maxPatternLength=length).findFrequentSequentialPatterns(ordered)
    return found.select(F.array_join(F.flatten("sequence"), " > ").alias("sequence"), F.col("freq").alias("count"))


def entities(df: DataFrame, text: Column, service: Column | None = None) -> DataFrame:
    """Entity type, value and count over all texts; the service of a row, where given, is an entity too."""
    found = [_typed(text, p, n) for n, p in C.ENTITIES.items()]
    if service is not None:
        one = F.struct(F.lit("SERVICE").alias("type"), service.alias("value"))
        found.append(F.when(service.isNotNull(), F.array(one)).otherwise(F.array().cast("array<struct<type:string,value:string>>")))
    found = F.concat(*found)
    return df.select(F.explode(found).alias("e")).groupBy("e.type", "e.value").agg(F.count("*").alias("count"))


def _typed(text: Column, pattern: str, name: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.struct(F.lit(name).alias("type"), v.alias("value")))


def sentiment_by(logs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by sentiment class and the mean score, overall class at ±0.2."""
    rows = logs.withColumn("_s", C.sentiment_score(F.col("message"), F.col("level")))
    kind = C.sentiment(F.col("_s"))
    out = rows.groupBy(*keys).agg(F.count_if(kind == "positive").alias("positive"), F.count_if(kind == "neutral").alias("neutral"), F.count_if(kind == "negative").alias("negative"), F.avg("_s").alias("mean"))
    return out.withColumn("overall", F.when(F.col("mean") < -0.2, "negative").when(F.col("mean") > 0.2, "positive").otherwise("neutral"))


def words(text: Column, longer: int = 2) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) > longer)


def key_phrases(df: DataFrame, text: Column, least: int = 3, most: int = 20, first: int = 2000) -> DataFrame:
    """Two- and three-word phrases that aren't all stop words: count and count * ln(words + 1).

    Phrases are counted on a table of counters, which bounds each one's count from above. Those on
    the ``first`` counters by score are counted exactly; so are then all others whose counter
    reaches the last place of those, however many they are.
    """
    texts, stop = df.filter(text.isNotNull()).select(F.lower(text).alias("text")), tuple(w for w in STOP if len(w) > 2)
    bounds = counters(texts, 2, stop)
    scores = np.where(bounds >= least, bounds * np.log([[n + 1] for n in LENGTHS]), 0.0)
    chosen = (scores > 0) & (scores >= np.partition(scores.reshape(-1), -first)[-first])
    found = _scored(texts, stop, chosen, least)
    ranked = found.orderBy(F.desc("score"), "phrase").limit(most)
    places = [r.score for r in ranked.select("score").collect()]
    # a last digit's difference between logarithms must not lose a tie
    missed = ~chosen & (scores > 0) & (scores >= (places[-1] * (1 - 1e-12) if len(places) == most else 0))
    return found.unionByName(_scored(texts, stop, missed, least)).orderBy(F.desc("score"), "phrase").limit(most) if missed.any() else ranked


def _scored(texts: DataFrame, stop: tuple[str, ...], chosen: np.ndarray, least: int) -> DataFrame:
    out = phrases_on(texts, 2, stop, chosen).groupBy("phrase", "words").agg(F.sum("n").alias("count")).filter(F.col("count") >= least)
    return cut_lineage(out.select("phrase", "count", (F.col("count") * F.log(F.col("words") + 1)).alias("score")))


def languages(df: DataFrame, text: Column, key: str) -> DataFrame:
    """Language of each text by its indicator words; the most hits win, the first by name of ties."""
    tokens = F.split(F.lower(text), r"[^\p{L}]+")
    hits = F.array(*[_hits(tokens, v, i, k) for i, (k, v) in enumerate(sorted(LANGUAGE_WORDS.items()))])
    best = F.array_max(hits)
    return df.select(key, F.when(best["n"] > 0, best["l"]).otherwise("unknown").alias("language"))


def _hits(tokens: Column, vocabulary: str, place: int, name: str) -> Column:
    return F.struct(F.size(F.filter(tokens, lambda t: t.isin(*vocabulary.split()))).alias("n"), F.lit(-place).alias("o"), F.lit(name).alias("l"))


def themes(df: DataFrame, text: Column, n: int = 5) -> DataFrame:
    """The commonest words of over three letters that aren't stop words."""
    return df.select(F.explode(words(text, 3)).alias("word")).filter(~F.col("word").isin(*STOP)).groupBy("word").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "word").limit(n)


def common_terms(df: DataFrame, group: str, text: Column) -> DataFrame:
    """Words in at least max(2, half) of a group's values."""
    rows = df.select(group, F.explode(F.array_distinct(words(text))).alias("term"))
    size = df.groupBy(group).agg(F.count("*").alias("_n"))
    return rows.groupBy(group, "term").agg(F.count("*").alias("count")).join(size, group).filter(F.col("count") >= F.greatest(F.lit(2), F.col("_n") / 2)).drop("_n")


def flatten_text(texts: Sequence[Column] = (), maps: Sequence[Column] = (), values: Sequence[Column] = ()) -> Column:
    """Text columns, map entries as k:"v", and the first value that is there."""
    parts = list(texts) + [F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(':"'), e["value"], F.lit('"'))), " ") for m in maps]
    if values:
        parts.append(F.coalesce(*[v.cast("string") for v in values]))
    return F.concat_ws(" ", *parts)


def trace_text(spans: DataFrame) -> DataFrame:
    """One text a trace from its spans' services, operations and errors."""
    part = F.concat_ws(" ", "service", "operation", F.when(F.col("is_error"), F.concat_ws(" ", F.lit("error"), "error_type")))
    return spans.groupBy("trace_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_ts", "span_id", part.alias("t")))), lambda x: x["t"]), " ").alias("text"))


def error_clusters(df: DataFrame, kind: Column, message: Column, n: int = 10) -> DataFrame:
    """Errors by type and the first fifty characters."""
    return df.groupBy(kind.alias("type"), F.substring(message, 1, 50).alias("prefix")).agg(F.count("*").alias("count"), F.min(message).alias("example")).orderBy(F.desc("count"), "type", "prefix").limit(n)


def hit_distribution(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """burst (< 1 m), rapid (< 5 m), intermittent (largest gap over five times the mean), else continuous."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(*keys, us.alias("_t"), ((us - F.lag(us).over(Window.partitionBy(*keys).orderBy(ts))) / 1e6).alias("_g"))
    out = rows.groupBy(*keys).agg(((F.max("_t") - F.min("_t")) / 1e6).alias("span_s"), F.max("_g").alias("max_gap"), F.avg("_g").alias("mean_gap"))
    return out.withColumn("kind", F.when(F.col("span_s") < 60, "burst").when(F.col("span_s") < 300, "rapid").when(F.col("max_gap") > 5 * F.col("mean_gap"), "intermittent").otherwise("continuous"))
