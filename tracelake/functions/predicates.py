"""Column-returning filters: terms, ranges, wildcards, text matches and their combinations."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_LEVELS = ("error", "fatal", "critical")


def _quote(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z_ ])", r"\\\1", text)


def term(c: Column, value) -> Column:
    return c == F.lit(value)


def terms(c: Column, values: Iterable) -> Column:
    return c.isin(list(values))


def between(c: Column, gte=None, lte=None, gt=None, lt=None) -> Column:
    tests = [t for v, t in ((gte, c >= F.lit(gte)), (lte, c <= F.lit(lte)), (gt, c > F.lit(gt)), (lt, c < F.lit(lt))) if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def exists(c: Column) -> Column:
    return c.isNotNull()


def missing(c: Column) -> Column:
    return c.isNull()


def wildcard(c: Column, pattern: str, case_sensitive: bool = True) -> Column:
    """``*`` stands for any run of characters; the whole value must fit."""
    body = ".*".join(_quote(p) for p in pattern.split("*"))
    return c.rlike(f"{'' if case_sensitive else '(?i)'}^(?s){body}$")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^0-9a-z]+"), lambda t: t != "")


def match(c: Column, text: str, operator: str = "or", fuzzy: bool = False) -> Column:
    """Analysed match: any (or all) words of the text; fuzzy allows 1 edit to 5 letters, 2 beyond."""
    words = [w for w in re.split(r"[^0-9a-z]+", text.lower()) if w]
    own = tokens(c)

    def one(w: str) -> Column:
        if not fuzzy or len(w) < 3:
            return F.array_contains(own, w)
        return F.exists(own, lambda t: F.levenshtein(t, F.lit(w)) <= (1 if len(w) <= 5 else 2))

    tests = [one(w) for w in words]
    return reduce((lambda a, b: a & b) if operator == "and" else (lambda a, b: a | b), tests) if tests else F.lit(False)


def phrase(c: Column, text: str) -> Column:
    return F.contains(F.lower(c), F.lit(text.lower()))


def contains_all(columns: Iterable[Column], text: str) -> Column:
    """Every word of the query stands in one of the columns."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return reduce(lambda a, b: a & b, [F.contains(hay, F.lit(w)) for w in text.lower().split()], F.lit(True))


def bool_(must: Iterable[Column] = (), should: Iterable[Column] = (), must_not: Iterable[Column] = (), min_should: int | None = None) -> Column:
    must, should, must_not = list(must), list(should), list(must_not)
    out = reduce(lambda a, b: a & b, must, F.lit(True))
    if should:
        need = min_should if min_should is not None else (0 if must else 1)
        out &= reduce(lambda a, b: a + b, [F.coalesce(s.cast("int"), F.lit(0)) for s in should]) >= need
    for n in must_not:
        out &= ~F.coalesce(n, F.lit(False))
    return out


def normal_service(c: Column) -> Column:
    return F.lower(F.trim(c))


def service_filter(c: Column, pattern: str, exact: bool = False, case_sensitive: bool = False) -> Column:
    """Exact, wildcard where the pattern holds ``*``, else contains."""
    if "*" in pattern:
        return wildcard(c, pattern, case_sensitive)
    if not case_sensitive:
        c, pattern = F.lower(c), pattern.lower()
    return c == pattern if exact else F.contains(c, F.lit(pattern))


def search_logs(logs: DataFrame, text: str = "", start=None, end=None, service: str | None = None, level: str | None = None, trace_id: str | None = None, span_id: str | None = None, errors_only: bool = False) -> DataFrame:
    """Logs that fit all given filters; sort newest first with ``newest``."""
    tests = [contains_all([F.col("message"), F.col("service")], text)] if text else []
    if start is not None or end is not None:
        tests.append(between(F.col("ts"), gte=start, lte=end))
    if service:
        tests.append(service_filter(F.col("service"), service))
    if level:
        tests.append(F.lower("level") == level.lower())
    if errors_only:
        tests.append(F.lower("level").isin(*ERROR_LEVELS))
    if trace_id:
        tests.append(F.col("trace_id") == trace_id)
    if span_id:
        tests.append(F.col("span_id") == span_id)
    return logs.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def search_traces(spans: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Spans whose operation or service holds all words, newest first."""
    out = newest(spans.filter(contains_all([F.col("operation"), F.col("service")], text)), "start_ts", "span_id")
    return out.limit(limit) if limit else out


def newest(df: DataFrame, ts: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc_nulls_last(), *ties)


def highlight(c: Column, words: Iterable[str]) -> Column:
    body = "|".join(_quote(w) for w in words)
    return F.regexp_replace(c, f"(?i)({body})", "<mark>$1</mark>")
