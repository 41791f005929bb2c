"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree's levels are columns of the documents, from domain down to source. A budget of tokens is
handed down: the children of a node share its allocation by their weights, but none gets more than
its subtree can give (tokens times the allowed epochs); what one cannot take goes to its siblings.
A node is only ever given what its subtree can hold, so a shortage is made up among siblings first
and reaches the ancestors' other branches only when the siblings are used up.

A leaf then reads its documents in seeded epochs: every full epoch takes all, the last one a prefix
of its tokens in the order of a seeded digest. The prefix is found by bucketing that order: only the
bucket in which it ends is ordered row by row, so a leaf with a third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import settled

DIGITS = 3  # hex digits of the seeded digest that name a bucket: 4,096 buckets a leaf


def words(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _path(columns: Sequence[str]) -> Column:
    """One string for the values of `columns`; null is a value of its own."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]), {"ignoreNullFields": "false"}) if columns else F.lit("[]")


def _weight(column: str, weights: Mapping[str, int], default: int) -> Column:
    chosen = F.lit(default)
    for value, weight in weights.items():
        if weight < 0:
            raise ValueError("weights must not be negative")
        chosen = F.when(F.col(column) == value, weight).otherwise(chosen)
    return chosen.cast("double")


def allocate(leaves: DataFrame, tree: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: int, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """Budget per leaf: the columns of `tree`, available, allocated (whole tokens).

    `leaves`: the columns of `tree` and `available`. Weights are relative among siblings; weight 0
    takes nothing. Of a budget larger than everything times `max_epochs`, everything is taken.
    """
    zero = F.lit(False)
    for level in tree:
        zero = zero | (_weight(level, weights.get(level, {}), default_weight) == 0)
    now = leaves.withColumn("_cap", F.when(zero, 0).otherwise(F.col("available") * max_epochs).cast("double"))
    total = now.agg(F.sum("_cap")).first()[0] or 0.0
    parents = None
    for depth, level in enumerate(tree):
        path = list(tree[: depth + 1])
        nodes = now.groupBy(*path).agg(F.sum("_cap").alias("_cap")).withColumns(
            {"_path": _path(path), "_parent": _path(path[:-1]), "_w": _weight(level, weights.get(level, {}), default_weight)}
        )
        if parents is None:
            nodes = nodes.withColumn("_given", F.lit(float(min(budget, total))))
        else:
            nodes = nodes.join(parents, "_parent")
        # Children in the order in which they are used up as the level rises. Before each: what the
        # earlier ones hold, and the weight of the rest; the level is the highest that this gives.
        ratio = F.when(F.col("_cap") == 0, 0.0).otherwise(F.col("_cap") / F.col("_w"))
        order = Window.partitionBy("_parent").orderBy(ratio, "_path")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        siblings = Window.partitionBy("_parent")
        weight = F.when(F.col("_cap") == 0, 0.0).otherwise(F.col("_w"))
        nodes = nodes.withColumn("_w", weight)
        rest = F.sum("_w").over(siblings) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
        filled = F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
        nodes = nodes.withColumn("_level", F.when(rest > 0, (F.col("_given") - filled) / rest))
        nodes = nodes.withColumn("_level", F.max("_level").over(siblings))
        nodes = nodes.withColumn("_given", F.coalesce(F.least(F.col("_cap"), F.col("_w") * F.col("_level")), F.lit(0.0)))
        parents = nodes.select(F.col("_path").alias("_parent"), "_given")
    given = nodes.select(F.col("_path").alias("_leaf"), F.floor("_given").cast("bigint").alias("allocated"))
    return leaves.withColumn("_leaf", _path(tree)).join(given, "_leaf").select(*tree, "available", "allocated", "_leaf")


def mix(
    docs: DataFrame, tree: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: tuple[int, int], max_epochs: int, seed: int, keys: Sequence[str] = ("doc_id",), default_weight: int = 1
) -> DataFrame:
    """What is drawn: `keys`, the columns of `tree`, n_tokens, epochs (times in full), prefix_tokens
    (tokens in the last, partial epoch), drawn_tokens; documents of which nothing is drawn are left
    out.

    `docs`: `keys`, `tree` and n_tokens (null or negative counts as 0). The budget is the share
    budget[0] / budget[1] of all tokens. The order of a leaf's epoch is that of the MD5 digest of seed,
    epoch and first key, then the keys; rows equal in them follow each other in any order. Null in a
    tree column is a branch of its own. An empty table gives no rows.
    """
    tree, keys = list(tree), list(keys)
    rows = docs.select(*keys, *tree, F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint"), F.lit(0)).alias("n_tokens"))
    rows = settled(rows.withColumn("_leaf", _path(tree)), "mix-rows")
    leaves = rows.groupBy(*tree).agg(F.sum("n_tokens").alias("available"))
    total = leaves.agg(F.sum("available")).first()[0] or 0
    given = allocate(leaves, tree, weights, total * budget[0] // budget[1], max_epochs, default_weight).filter("available > 0")
    given = given.select("_leaf", F.expr("allocated div available").alias("epochs"), (F.col("allocated") % F.col("available")).alias("_rest"))
    given = settled(given, "mix-leaves")
    key = F.coalesce(F.col(keys[0]).cast("string"), F.lit(""))
    rows = rows.join(given, "_leaf").withColumn("_order", F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("epochs") + 1).cast("string"), key)))
    rows = rows.withColumn("_bucket", F.substring("_order", 1, DIGITS))
    sums = rows.groupBy("_leaf", "_bucket").agg(F.sum("n_tokens").alias("_tokens"))
    earlier = Window.partitionBy("_leaf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = settled(sums.withColumn("_before", F.coalesce(F.sum("_tokens").over(earlier), F.lit(0))), "mix-buckets")
    rows = rows.join(sums, ["_leaf", "_bucket"]).withColumn("_left", F.col("_rest") - F.col("_before"))
    whole = rows.filter("_left <= 0 OR _left >= _tokens").withColumn("prefix_tokens", F.when(F.col("_left") <= 0, F.lit(0)).otherwise(F.col("n_tokens")))
    inside = Window.partitionBy("_leaf", "_bucket").orderBy("_order", *keys).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.filter("_left > 0 AND _left < _tokens").withColumn("_left", F.col("_left") - F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    ends = ends.withColumn("prefix_tokens", F.least(F.greatest(F.col("_left"), F.lit(0)), F.col("n_tokens")))
    shown = [*keys, *tree, "n_tokens", "epochs", "prefix_tokens"]
    drawn = whole.select(*shown).unionByName(ends.select(*shown))
    drawn = drawn.withColumn("drawn_tokens", F.col("epochs") * F.col("n_tokens") + F.col("prefix_tokens"))
    return drawn.filter("drawn_tokens > 0")
