"""Counters and table checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.functions import text, vectors

# Report wording.
PASSED = "Setup check passed."
FAILED = "Setup check failed."
DETAIL_INDENT = "       "


def hit_report(results: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Requests, hits, generated answers, inserts and hit rate per collection.

    With ``rejected``, misses whose answer could not be stored count as requests and as misses too.
    """
    missed = ~F.col("cache_hit")
    if rejected is not None:
        failed = rejected.where(F.col("reject_reason") == S.RESPONSE_BLANK)
        failed = failed.select("collection", F.lit(False).alias("cache_hit"), F.lit(None).cast("string").alias("response"))
        results = results.select("collection", "cache_hit", "response").unionByName(failed)
    return results.groupBy("collection").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("cache_hit").alias("hits"),
        F.count_if(missed).alias("misses"),
        F.count_if(missed & text.is_filled("response")).alias("inserts"),
        F.avg(F.col("cache_hit").cast("double")).alias("hit_rate"),
    )


def table_checks(entries: DataFrame, max_capacity: int = S.DEFAULT_CAPACITY) -> DataFrame:
    """One CHECK row per rule, from one pass over the entries.

    A failing rule is a row with a count, not an exception.
    """
    S.check_capacity(max_capacity)
    bad_vector = vectors.vector_reason("vector").isNotNull()
    late = F.col("last_accessed_at") < F.col("created_at")
    per_collection = entries.groupBy("collection").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~text.is_filled("prompt")).alias("prompts"),
        F.count_if(~text.is_filled("response")).alias("responses"),
        F.count_if(bad_vector).alias("vectors"),
        F.count_if(F.coalesce(late, F.lit(True))).alias("times"),
        F.min(F.size("vector")).alias("low"),
        F.max(F.size("vector")).alias("high"),
    )
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    totals = per_collection.agg(
        total("prompts").alias("prompts"),
        total("responses").alias("responses"),
        total("vectors").alias("vectors"),
        F.count_if(F.col("low") != F.col("high")).alias("dimensions"),
        F.count_if(F.col("n") > max_capacity).alias("capacity"),
        total("times").alias("times"),
    )
    rules = [
        ("prompts", "entries with a blank prompt"),
        ("responses", "entries with a blank response"),
        ("vectors", "entries with an unusable vector"),
        ("dimensions", "collections with mixed dimensions"),
        ("capacity", "collections over capacity"),
        ("times", "entries accessed before creation"),
    ]
    stacked = F.stack(
        F.lit(len(rules)),
        *[x for name, what in rules for x in (F.lit(name), F.col(name), F.lit(what))],
    ).alias("name", "found", "what")
    healthy = F.col("found") == 0
    return totals.select(stacked).select(
        "name",
        healthy.alias("healthy"),
        F.when(healthy, F.concat(F.lit("no "), "what")).otherwise(F.col("what")).alias("message"),
        F.when(~healthy, F.concat(F.col("found").cast("string"), F.lit(" found"))).alias("details"),
    )


def line(name: str = "name", healthy: str = "healthy") -> Column:
    """Report text of one check, with its details on a second, indented line."""
    status = F.when(F.col(healthy), F.lit("[OK] ")).otherwise(F.lit("[FAIL] "))
    first = F.concat(status, F.col(name), F.lit(": "), F.col("message"))
    filled = F.length(F.coalesce("details", F.lit(""))) > 0
    return F.when(filled, F.concat(first, F.lit("\n" + DETAIL_INDENT), "details")).otherwise(first)


def all_healthy(checks: DataFrame) -> DataFrame:
    """One row; true for no checks at all."""
    return checks.agg(F.coalesce(F.bool_and("healthy"), F.lit(True)).alias("all_healthy"))


def report_text(checks: DataFrame) -> DataFrame:
    """One row with the whole report; ``checks`` is the fixed, short list of rules."""
    passed = F.coalesce(F.bool_and("healthy"), F.lit(True))
    lines = F.array_sort(F.collect_list(F.struct("name", line().alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    head = F.when(passed, F.lit(PASSED)).otherwise(F.lit(FAILED))
    return checks.agg(
        passed.alias("all_healthy"), F.concat(head, F.lit("\n\n"), body).alias("report")
    )
