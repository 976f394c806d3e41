"""Mixing sources to target weights by hierarchical budgeting (operator 5).

A tree domain - language - source holds the documents in its leaves. The token budget flows from the
root: siblings share their parent's budget by weight, and one that has fewer tokens than its share
gives the rest to its siblings first. A whole subtree that falls short is short at its parent's
level, so only then its siblings there take over. Every leaf then takes whole epochs and a
token-prefix of one more, in an order seeded for each epoch.

The budgets are computed on one row a leaf. The prefix of a leaf ends at a cut point of its seeded
order, found from sums over 4,096 hash ranges and an exact sum within the one range that holds it,
so that no leaf, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut, drop

#: Hex digits of the seeded order that make a range.
RANGE_DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def weight_of(key: Column, weights: dict[str, int], default: int = 1) -> Column:
    """A key's weight: a whole number, at least 0."""
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default)).cast("long") if pairs else F.lit(default).cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str, budget: str, weight: str, cap: str, out: str) -> DataFrame:
    """Divide each parent's ``budget`` among its children by ``weight``, none above its ``cap``; whole tokens, nothing lost.

    Children that reach their cap are found in the order of cap to weight; the others share what is
    left in proportion, and the last tokens go one each to the first of them. Weight 0 gets nothing.
    """
    d = lambda c: F.col(c).cast("decimal(38,0)")
    w = Window.partitionBy(*parent)
    by = w.orderBy(F.when(F.col(weight) > 0, F.col(cap).cast("double") / F.col(weight)).otherwise(F.lit(float("inf"))), name)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumn("_w", F.sum(d(weight)).over(rest)).withColumn("_c", F.coalesce(F.sum(d(cap)).over(before), F.lit(0)))
    n = n.withColumn("_full", (F.col(weight) > 0) & (d(cap) * F.col("_w") <= d(weight) * (d(budget) - F.col("_c"))))
    n = n.withColumn("_left", d(budget) - F.coalesce(F.sum(F.when(F.col("_full"), d(cap))).over(w), F.lit(0)))
    n = n.withColumn("_open", F.coalesce(F.sum(F.when(~F.col("_full"), d(weight))).over(w), F.lit(0)))
    n = n.withColumn("_part", F.when(F.col("_full") | (F.col("_open") == 0), F.lit(0)).otherwise(F.expr(f"(_left * cast({weight} as decimal(38,0))) div _open")).cast("decimal(38,0)"))
    n = n.withColumn("_over", F.when(F.col("_open") > 0, F.col("_left") - F.sum("_part").over(w)).otherwise(F.lit(0)))
    n = n.withColumn("_nth", F.sum(F.when(~F.col("_full") & (F.col(weight) > 0), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    more = F.when((F.col(weight) > 0) & (F.col("_nth") <= F.col("_over")), 1).otherwise(0)
    n = n.withColumn(out, F.when(F.col("_full"), d(cap)).otherwise(F.col("_part") + more).cast("long"))
    return n.drop("_w", "_c", "_full", "_left", "_open", "_part", "_over", "_nth")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], budget_percent: int, epochs: int) -> DataFrame:
    """``leaves`` (one row a leaf with ``tokens``) with its ``budget``: ``budget_percent`` of all tokens, ``epochs`` times a leaf's tokens at most.

    A subtree can hold what its leaves under keys of positive weight hold, so nothing is given to it
    that its children may not take. Siblings, and for the total all leaves, meet in one window: these
    are rows of the tree, not of the documents.
    """
    tree = leaves.withColumn("_budget0", F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * budget_percent / F.lit(100)).cast("long"))
    for depth, (level, own) in enumerate(zip(levels, weights, strict=True)):
        path = levels[: depth + 1]
        open_below = F.lit(True)
        for lower, theirs in list(zip(levels, weights, strict=True))[depth + 1 :]:
            open_below = open_below & (weight_of(F.col(lower), theirs) > 0)
        cap = F.sum(F.when(open_below, F.col("tokens") * epochs).otherwise(0))
        nodes = tree.groupBy(*path).agg(cap.alias("_cap"), F.max(f"_budget{depth}").alias("_budget")).withColumn("_weight", weight_of(F.col(level), own))
        parent = levels[:depth] or [F.lit(0)]
        nodes = share_out(nodes, parent, level, "_budget", "_weight", "_cap", f"_budget{depth + 1}")
        tree = tree.join(nodes.select(*path, f"_budget{depth + 1}"), path)
    return tree.select(*leaves.columns, F.col(f"_budget{len(levels)}").alias("budget"))


def mix(documents: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], budget_percent: int = 60, epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The chosen rows with ``keep`` columns (all by default) as a struct ``row``, the levels' keys, ``n_tokens`` and ``epoch``.

    ``levels`` gives the tree from the root down, with a column for each level's key; a null key is
    the key ''. Tokens are words. A row without words (null and empty texts too) is never chosen.
    A row of epoch e is a leaf's e-th copy, from 0; a leaf with budget for f whole epochs has all its
    rows in the first f and, in one more, those that come first in the order of
    md5(seed:epoch:id) while their tokens fit. Rows of one id stand together in that order.
    A null id counts as ''. An empty table gives no rows.
    """
    names = list(levels)
    inner = [f"_l{i}" for i in range(len(names))]
    base = documents.select(
        F.struct(*[F.col(c) for c in (keep or documents.columns)]).alias("row"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(i) for i, c in zip(inner, levels.values(), strict=True)],
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    light = cut(base.drop("row").where("n_tokens > 0"), "tokens")
    leaves = light.groupBy(*inner).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, inner, weights, budget_percent, epochs)
    plan = cut(plan.select(*inner, F.expr("budget div tokens").alias("_whole"), (F.col("budget") % F.col("tokens")).alias("_rest")), "budgets")

    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.col("_id")))
    placed = light.join(plan.where("_rest > 0"), inner).withColumn("_m", place).withColumn("_range", F.substring("_m", 1, RANGE_DIGITS))
    sums = placed.groupBy(*inner, "_range").agg(F.sum("n_tokens").alias("_n"), F.max("_rest").alias("_rest"))
    ends = sums.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*inner).orderBy("_range")))
    open_range = ends.where("_upto > _rest AND _upto - _n <= _rest").select(*inner, "_range", (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_room"))
    within = placed.join(open_range, [*inner, "_range"]).withColumn("_sum", F.sum("n_tokens").over(Window.partitionBy(*inner, "_range").orderBy("_m", "_id")))
    last = within.where("_sum <= _room").groupBy(*inner, "_range").agg(F.max(F.struct("_m", "_id")).alias("_last"))
    ends = open_range.join(last, [*inner, "_range"], "left").select(*inner, F.col("_range").alias("_stop"), "_last")
    budgets, plan = plan, cut(plan.join(ends, inner, "left"), "cuts")
    drop(light, budgets)

    m = base.where("n_tokens > 0").join(plan, inner).withColumn("_m", place)
    head = F.substring("_m", 1, RANGE_DIGITS) < F.col("_stop")
    inside = (F.substring("_m", 1, RANGE_DIGITS) == F.col("_stop")) & F.col("_last").isNotNull() & (F.struct("_m", "_id") <= F.col("_last"))
    extra = F.coalesce((F.col("_rest") > 0) & (head | inside), F.lit(False))
    count = F.col("_whole") + extra.cast("long")
    m = m.withColumn("_count", count).where("_count > 0")
    return m.select("row", *[F.col(i).alias(n) for i, n in zip(inner, names, strict=True)], "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)).alias("epoch"))
