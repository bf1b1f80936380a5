"""Row schemas, fixed messages and eager parameter checks."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_STRING, _LONG, _TIME = T.StringType(), T.LongType(), T.TimestampType()

ENTRY = _struct(
    collection=_STRING, id=_STRING, seq=_LONG, prompt=_STRING, response=_STRING,
    vector=VECTOR, norm=T.DoubleType(), created_at=_TIME, last_accessed_at=_TIME,
)
REQUEST = _struct(
    collection=_STRING, request_id=_STRING, seq=_LONG, ts=_TIME, prompt=_STRING, vector=VECTOR
)
RESULT = _struct(
    collection=_STRING, request_id=_STRING, prompt=_STRING, response=_STRING,
    cache_hit=T.BooleanType(), score=T.DoubleType(), entry_id=_STRING,
)
ANSWER = _struct(prompt=_STRING, response=_STRING)
REJECT = _struct(collection=_STRING, request_id=_STRING, reject_reason=_STRING)
CHECK = _struct(name=_STRING, healthy=T.BooleanType(), message=_STRING, details=_STRING)
TOUCH = _struct(collection=_STRING, seq=_LONG, touched_at=_TIME)
KEY = _struct(collection=_STRING, seq=_LONG)

# Message texts, defaults and names that callers match on.
PROMPT_BLANK = "prompt must be a non-empty string"
RESPONSE_BLANK = "response must be a non-empty string"
VECTOR_EMPTY = "vector must not be empty"
VECTOR_ZERO = "vectors must not be zero vectors"
VECTOR_DIMENSION = "vectors must have the same dimension"
VECTOR_NOT_FINITE = "vector must be finite"
DEFAULT_THRESHOLD = 0.8
DEFAULT_CAPACITY = 1000
BASELINE_CACHED_PROMPT = "cached prompt"
BASELINE_CACHED_RESPONSE = "cached answer"
BASELINE_GENERATED_RESPONSE = "generated answer"
ENTRY_ID_PREFIX = "entry-"

METRICS = ("cosine", "l2sq", "l2")
STORES = ("cosine", "distance", "always_miss", "always_hit")

# Eviction order of each policy: the first rows in this order go first.
POLICY_ORDER = {"lru": ("last_accessed_at", "seq"), "fifo": ("seq",)}


def check_threshold(threshold: float) -> float:
    if not 0 <= threshold <= 1:
        raise ValueError(f"similarity_threshold must be between 0 and 1. Got: {threshold}")
    return float(threshold)


def check_capacity(capacity: int) -> int:
    if capacity < 1:
        raise ValueError(f"max_capacity must be at least 1. Got: {capacity}")
    return int(capacity)


def check_text(value: str, name: str) -> str:
    if not value or not value.strip():
        raise ValueError(f"{name} must be a non-empty string")
    return value


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric '{metric}'. Supported metrics: {', '.join(METRICS)}")
    return metric


def check_store(store: str) -> str:
    if store not in STORES:
        raise ValueError(f"unknown store '{store}'. Supported stores: {', '.join(STORES)}")
    return store


def resolve_metric(store: str | None, metric: str | None) -> tuple[str, str]:
    """Store and metric, each filled in from the other; a similarity and a distance do not go together."""
    if metric is not None:
        check_metric(metric)
    if store is None:
        store = "distance" if metric in ("l2sq", "l2") else "cosine"
    check_store(store)
    if metric is None:
        metric = "l2sq" if store == "distance" else "cosine"
    if store in ("cosine", "distance") and (store == "cosine") != (metric == "cosine"):
        raise ValueError(f"store '{store}' does not compare by metric '{metric}'")
    return store, metric


def resolve_policy(policy, store: str = "cosine") -> tuple[str, ...] | None:
    """Ordering columns of an eviction policy, or None when nothing is ever evicted.

    ``policy`` is ``default``, ``lru``, ``fifo``, ``none`` or a sequence of entry columns.
    ``default`` means LRU for the two real stores and no eviction for the two baselines.
    """
    check_store(store)
    if not isinstance(policy, str):
        columns = tuple(policy)
        unknown = [c for c in columns if c not in ENTRY.fieldNames()]
        if unknown or not columns:
            raise ValueError(f"eviction policy must order by entry columns. Got: {columns}")
        return columns if columns[-1] == "seq" else (*columns, "seq")
    name = policy.strip().lower()
    baseline = store in ("always_miss", "always_hit")
    if name == "default":
        return None if baseline else POLICY_ORDER["lru"]
    if name == "none":
        return None
    if name not in POLICY_ORDER:
        raise ValueError(
            f"Unknown eviction policy '{policy}'. "
            f"Supported eviction policies: default, none, {', '.join(POLICY_ORDER)}"
        )
    if baseline:
        raise ValueError(f"Eviction policy '{policy}' is not supported by store '{store}'")
    return POLICY_ORDER[name]
