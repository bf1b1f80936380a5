"""Mixing sources to target weights through a tree of domains, languages and sources.

The budget of tokens goes down the tree. A node's children share its budget by their weights; a
child that has fewer tokens than its share (in all epochs together) takes what it has, and its
siblings share the rest by their weights. What a node can hold is known from its leaves, so a
shortage goes to siblings first and reaches an ancestor's siblings only when the whole node is
exhausted. All of it is integer arithmetic on a table with a row for each leaf.

A leaf with budget b and a tokens gives all its documents ``b // a`` times, and of the next epoch
the first documents in that epoch's seeded order until the rest of the budget is reached: a document
is taken if the documents before it have fewer tokens than that rest. Only documents of the one
bucket of hashes in which the rest ends are ordered in a window; the buckets before it are taken and
those after it are not, by their summed tokens alone. So a leaf with a third of all rows is never
brought together, and the texts never move.

Defined results: null names are nodes of their own, apart from an empty name; a node that the
weights do not name has ``DEFAULT_WEIGHT``; weight 0 gives nothing; null or negative sizes count as
0, and documents of size 0 are taken while some budget is left before them; repeated rows each
count and are taken or left together, as equal rows have equal places; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echocache.scratch import materialize

DEFAULT_WEIGHT = 100
#: Buckets of a leaf's documents, and epochs that a leaf may give.
BUCKET_DIGITS, MAX_EPOCHS = 3, 4
#: Leaves of the tree that are broadcast; a tree with more is joined by shuffles.
MAX_BROADCAST = 100_000

_NUMBER = "decimal(38,0)"


def _place(seed: int, epoch: Column, key: Column) -> Column:
    """Where a document stands in an epoch: a hash of 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("-"))))


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``budget`` to children with ``weight``, ``held`` and ``total``, their parent's budget.

    Children are taken by ascending ``held / weight``: if even the first cannot use its share of
    what is left, it takes all it holds. Those after the last such child share by weight.
    """
    order = Window.partitionBy(*parent).orderBy(
        F.col("held").cast("double") / F.col("weight").cast("double"), F.asc_nulls_first(name)
    )
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*parent)
    number = lambda c: F.coalesce(c, F.lit(0)).cast(_NUMBER)
    out = (
        children.where("weight > 0")
        .withColumn("_held_before", number(F.sum("held").over(upto)))
        .withColumn("_weight_left", number(F.sum("weight").over(group)) - number(F.sum("weight").over(upto)))
        .withColumn("_left", F.greatest(F.col("total").cast(_NUMBER) - F.col("_held_before"), F.lit(0).cast(_NUMBER)))
        .withColumn("_full", F.col("held").cast(_NUMBER) * F.col("_weight_left") <= F.col("weight") * F.col("_left"))
    )
    out = out.withColumn(
        "_shared", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group), F.lit(0)).cast(_NUMBER)
    ).withColumn(
        "_rest",
        F.greatest(F.col("total").cast(_NUMBER) - number(F.sum(F.when(F.col("_full"), F.col("held"))).over(group)), F.lit(0).cast(_NUMBER)),
    )
    budget = F.when(F.col("_full"), F.col("held")).otherwise(
        F.expr("CAST(weight * _rest DIV _shared AS BIGINT)")
    )
    return out.withColumn("budget", budget.cast("long")).drop(
        "_held_before", "_weight_left", "_left", "_full", "_shared", "_rest"
    )


def budgets(
    leaves: DataFrame, levels: list[str], weights: Mapping[str, int], total: int, max_epochs: int
) -> DataFrame:
    """Leaves with ``tokens`` get their ``budget``, out of ``total`` tokens for the whole tree.

    ``weights`` are whole numbers by the names on the way from the root, joined by ``/``; a node
    that is not listed has ``DEFAULT_WEIGHT``. What lies below a node of weight 0 gets nothing, and does not
    count as something that its ancestors hold, so that their other branches and siblings get its share.
    """
    spark = leaves.sparkSession
    none, live = [k for k, w in weights.items() if int(w) <= 0], leaves
    listed = spark.createDataFrame([(k, int(w)) for k, w in weights.items()] or [("", 0)], "path string, weight long")
    parents = None
    path_of = lambda names: F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names))
    if none:
        for depth in range(1, len(levels) + 1):
            live = live.where(~path_of(levels[:depth]).isin(none))
    for depth in range(1, len(levels) + 1):
        names, above = levels[:depth], levels[: depth - 1]
        path = path_of(names)
        nodes = live.groupBy(*names).agg((F.sum("tokens") * max_epochs).alias("held"))
        nodes = (
            nodes.withColumn("path", path).join(listed, "path", "left")
            .withColumn("weight", F.coalesce("weight", F.lit(DEFAULT_WEIGHT))).drop("path")
        )
        if parents is None:
            nodes = nodes.withColumn("total", F.lit(total).cast("long")).withColumn("_root", F.lit(0))
            parents = share_out(nodes, ["_root"], names[-1]).drop("_root")
        else:
            up = parents.select(*(F.col(c).alias(f"_up_{c}") for c in above), F.col("budget").alias("total"))
            same = [F.col(c).eqNullSafe(F.col(f"_up_{c}")) for c in above]
            on = same[0]
            for more in same[1:]:
                on = on & more
            nodes = nodes.join(up, on).drop(*(f"_up_{c}" for c in above))
            parents = share_out(nodes, above, names[-1])
        parents = parents.select(*names, "budget")
    same = [F.col(c).eqNullSafe(F.col(f"_up_{c}")) for c in levels]
    on = same[0]
    for more in same[1:]:
        on = on & more
    renamed = parents.select(*(F.col(c).alias(f"_up_{c}") for c in levels), "budget")
    return leaves.join(renamed, on, "left").select(
        *levels, "tokens", F.coalesce("budget", F.lit(0)).cast("long").alias("budget")
    )


def mix(
    df: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, int], *, key: str, tokens: Column,
    total: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = 0, out: str = "mix",
) -> DataFrame:
    """The chosen rows of ``df``, one for each epoch they are taken in, with the struct ``out``.

    ``levels`` gives the name and the column of each level, root first; ``tokens`` is the size of a
    row, ``key`` the column that the seeded order goes by. ``total`` is the budget in tokens, by
    default as many as there are. ``out`` has the levels, ``n_tokens`` and ``epoch``.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {out} already; choose another output name")
    names = list(levels)
    size = F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0))
    small = materialize(
        df.select(*(c.cast("string").alias(f"_l{i}") for i, c in enumerate(levels.values())), F.col(key).alias("_key"), size.alias("tokens")),
        "mix-sizes",
    )
    path = [f"_l{i}" for i in range(len(names))]
    leaves = materialize(small.groupBy(*path).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    if total is None:
        total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    planned = materialize(
        budgets(leaves, path, weights, total, max_epochs)
        .withColumn("whole", F.when(F.col("tokens") > 0, F.expr("LEAST(budget DIV tokens, " + str(max_epochs) + ")")).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
        .withColumn("leaf", F.xxhash64(*(F.coalesce(F.concat(F.lit("."), c), F.lit("-")) for c in path))),
        "mix-plan",
    )
    leaf = lambda found: F.xxhash64(*(F.coalesce(F.concat(F.lit("."), c), F.lit("-")) for c in found))

    # Rows of the last, partial epoch: whole buckets by their sums, one bucket by a window.
    near = F.broadcast if planned.count() <= MAX_BROADCAST else (lambda x: x)
    plan = near(planned.where("budget > 0").select("leaf", "whole", "rest"))
    rows = (
        small.select(leaf([F.col(c) for c in path]).alias("leaf"), "_key", "tokens")
        .join(plan, "leaf")
        .withColumn("place", _place(seed, F.col("whole"), F.col("_key")))
        .withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    )
    sums = rows.groupBy("leaf", "bucket").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    before = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = materialize(
        sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where("before < rest AND before + n >= rest")
        .select("leaf", F.col("bucket").alias("edge"), "before"),
        "mix-edges",
    )
    edge_rows = rows.join(edges, "leaf").where("bucket = edge")
    places = edge_rows.groupBy("leaf", "place", "before", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = materialize(
        places.withColumn("earlier", F.col("before") + F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
        .where("earlier < rest")
        .groupBy("leaf")
        .agg(F.max("place").alias("last")),
        "mix-last",
    )
    decided = planned.where("budget > 0").join(last, "leaf", "left").select("leaf", "whole", "last")

    packed = df.select(F.struct("*").alias("row"), *(c.cast("string").alias(f"_l{i}") for i, c in enumerate(levels.values())), size.alias("n_tokens"), F.col(key).alias("_key"))
    chosen = packed.withColumn("leaf", leaf([F.col(c) for c in path])).join(near(decided), "leaf")
    partial = F.when(_place(seed, F.col("whole"), F.col("_key")) <= F.col("last"), 1).otherwise(0)
    times = F.col("whole") + partial
    return (
        chosen.withColumn("times", times.cast("int"))
        .where("times > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
        .select("row.*", F.struct(*(F.col(f"_l{i}").alias(n) for i, n in enumerate(names)), "n_tokens", "epoch").alias(out))
    )
