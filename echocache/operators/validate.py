"""Valid and rejected rows of requests and entries, with the reason for each rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.functions import text, vectors

ON_INVALID = ("reject", "error")


def request_reason(with_vector: bool = False) -> Column:
    """First problem of a request in the order it would be noticed: prompt, then vector."""
    reasons = [text.prompt_reason("prompt")]
    if with_vector:
        reasons.append(vectors.vector_reason("vector"))
    return F.coalesce(*reasons)


def entry_reason() -> Column:
    """First problem of an entry to store: prompt, then response, then vector."""
    return F.coalesce(
        text.prompt_reason("prompt"), text.response_reason("response"), vectors.vector_reason("vector")
    )


def split(rows: DataFrame, reason: Column, on_invalid: str = "reject") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reject_reason``); ``error`` fails the query instead."""
    if on_invalid not in ON_INVALID:
        raise ValueError(f"on_invalid must be one of {', '.join(ON_INVALID)}")
    tagged = rows.withColumn("reject_reason", reason)
    if on_invalid == "error":
        failed = F.raise_error(F.col("reject_reason")).cast("string")
        checked = F.when(F.col("reject_reason").isNotNull(), failed)
        valid = tagged.withColumn("reject_reason", checked).where(F.col("reject_reason").isNull())
        return valid.drop("reject_reason"), tagged.limit(0)
    valid = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid, tagged.where(F.col("reject_reason").isNotNull())


def clean_requests(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prompt", text.clean("prompt"))


def clean_entries(rows: DataFrame) -> DataFrame:
    """Entries as stored: prompt stripped, response as given, norm computed once."""
    return rows.withColumns({"prompt": text.clean("prompt"), "norm": vectors.norm("vector")})


def dimension_reason(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests with ``reject_reason`` set where a cached vector of another length exists.

    A collection without entries rejects nothing: there is no vector to compare with.
    """
    sizes = entries.groupBy("collection").agg(
        F.min(F.size("vector")).alias("_low"), F.max(F.size("vector")).alias("_high")
    )
    size = F.size("vector")
    differs = (size != F.col("_low")) | (size != F.col("_high"))
    return (
        requests.join(sizes, "collection", "left")
        .withColumn("reject_reason", F.when(differs, F.lit(S.VECTOR_DIMENSION)))
        .drop("_low", "_high")
    )
