"""Vector arithmetic over ``array<double>`` columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echocache import schema as S

Vec = Column | str


def as_vector(vector: Vec) -> Column:
    return F.col(vector).cast(S.VECTOR) if isinstance(vector, str) else vector.cast(S.VECTOR)


def to_float32(vector: Vec) -> Column:
    """The value a vector has after a trip through a float32 wire field."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return column.cast("array<float>").cast(S.VECTOR)


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Vec) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def _same_size(left: Vec, right: Vec, value: Column) -> Column:
    """Fail the query on unequal lengths: ``zip_with`` would pad the shorter side with NULL."""
    return F.when(F.size(left) == F.size(right), value).otherwise(
        F.raise_error(F.lit(S.VECTOR_DIMENSION)).cast("double")
    )


def dot(left: Vec, right: Vec) -> Column:
    return _same_size(left, right, _total(F.zip_with(left, right, lambda x, y: x * y)))


def cosine(left: Vec, right: Vec) -> Column:
    length = norm(left) * norm(right)
    return F.when(length > 0, dot(left, right) / length).otherwise(
        F.raise_error(F.lit(S.VECTOR_ZERO)).cast("double")
    )


def l2sq(left: Vec, right: Vec) -> Column:
    return _same_size(
        left, right, _total(F.zip_with(left, right, lambda x, y: (x - y) * (x - y)))
    )


def l2(left: Vec, right: Vec) -> Column:
    return F.sqrt(l2sq(left, right))


def has_nonzero(vector: Vec) -> Column:
    return F.exists(vector, lambda x: x != 0)


def is_finite(vector: Vec) -> Column:
    # NaN compares above infinity, so one comparison covers both.
    inside = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))
    return F.forall(vector, inside)


def vector_reason(vector: Vec) -> Column:
    """Why a vector cannot be stored or searched with, or NULL when it can."""
    missing = F.coalesce(F.size(vector) <= 0, F.lit(True))
    return (
        F.when(missing, F.lit(S.VECTOR_EMPTY))
        .when(~is_finite(vector), F.lit(S.VECTOR_NOT_FINITE))
        .when(~has_nonzero(vector) | (norm(vector) == 0), F.lit(S.VECTOR_ZERO))
    )
