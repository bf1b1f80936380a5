"""Sequential models to compare with: one request at a time, plain Python."""

from __future__ import annotations

import math


def closeness(left, right, metric):
    if metric == "cosine":
        dot = sum(x * y for x, y in zip(left, right))
        return round(dot / (math.hypot(*left) * math.hypot(*right)), 12)
    return float(f"{-sum((x - y) ** 2 for x, y in zip(left, right)):.11e}")


def floor(threshold, metric):
    return {"cosine": threshold, "l2sq": -threshold, "l2": float(f"{-threshold * threshold:.11e}")}[metric]


def best(vector, entries, threshold, metric):
    """(seq, closeness) of the closest entry, or None; ``entries`` are (seq, vector) in list order."""
    top = None
    for seq, other in entries:
        near = closeness(vector, other, metric)
        if top is None or near > top[1]:
            top = (seq, near)
    return top if top is not None and top[1] >= floor(threshold, metric) else None


def replay(requests, threshold, metric, capacity=None, policy="lru", entries=()):
    """[(seq, hit, entry seq)] for (seq, vector) requests; ``entries`` are (seq, vector, used)."""
    held = [[seq, vector, used - 10**9] for seq, vector, used in entries]
    out = []
    for seq, vector in requests:
        found = best(vector, [(s, v) for s, v, _ in held], threshold, metric)
        if found is not None:
            out.append((seq, True, found[0]))
            next(h for h in held if h[0] == found[0])[2] = seq
            continue
        out.append((seq, False, None))
        if capacity is not None and len(held) >= capacity:
            order = (lambda h: (h[2], h[0])) if policy == "lru" else (lambda h: h[0])
            held.remove(min(held, key=order))
        held.append([seq, vector, seq])
    return out


def bounded_store(rows, inserts, capacity, policy):
    """Seqs left after storing ``inserts`` one by one; rows are (seq, last access)."""
    held = list(rows)
    for row in inserts:
        if len(held) >= capacity:
            order = (lambda r: (r[1], r[0])) if policy == "lru" else (lambda r: r[0])
            held.remove(min(held, key=order))
        held.append(row)
    return sorted(seq for seq, _ in held)
