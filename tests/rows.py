"""Small tables for tests."""

from __future__ import annotations

import datetime as dt

from echocache import schema as S

ZERO = dt.datetime(2024, 1, 1)


def at(second: float) -> dt.datetime:
    return ZERO + dt.timedelta(seconds=second)


def entries(spark, rows, collection="c"):
    """Entries from (seq, vector[, last access second[, prompt]])."""
    full = []
    for row in rows:
        seq, vector, used, prompt = (*row, *(None,) * (4 - len(row)))
        prompt = prompt or f"prompt {seq}"
        norm = sum(x * x for x in vector) ** 0.5
        full.append((collection, f"entry-{seq}", seq, prompt, f"response {seq}", vector, norm,
                     at(seq), at(seq if used is None else used)))
    return spark.createDataFrame(full, S.ENTRY)


def requests(spark, rows, collection="c"):
    """Requests from (seq, vector[, prompt])."""
    full = []
    for row in rows:
        seq, vector, prompt = (*row, *(None,) * (3 - len(row)))
        full.append((collection, f"r{seq}", seq, at(1000 + seq), prompt or f"prompt {seq}", vector))
    return spark.createDataFrame(full, S.REQUEST)


def collected(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())
