"""Majority votes over sampled edits and the stateless rules that judge them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MUTATING = ("move_before", "move_after", "reparent", "merge_flow")
MOST_OPS, LEAST_VOTES, LEAST_CONFIDENCE = 12, 2, 700


def votes(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Votes of distinct samples for each (op, node, ref); a sample with too many mutating ops is left out whole."""
    runaway = samples.groupBy(*keys, "sample_ix").agg(F.count_if(F.col("op").isin(*MUTATING)).alias("n")).where(F.col("n") > MOST_OPS).select(*keys, "sample_ix")
    kept = samples.join(runaway, [*keys, "sample_ix"], "left_anti")
    return kept.groupBy(*keys, "op", "node", "ref").agg(F.countDistinct("sample_ix").alias("votes"), F.max("confidence_pm").alias("confidence_pm"))


def verdicts(voted: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The first rule that an edit fails names its verdict: unknown id, context target, page crossing, confidence, majority.
    nodes: keys, node, page, context."""
    n = nodes.select(*keys, "node", F.col("page").alias("node_page"), F.col("context").alias("node_context"))
    r = nodes.select(*keys, F.col("node").alias("ref"), F.col("page").alias("ref_page"), F.col("context").alias("ref_context"))
    j = voted.join(n, [*keys, "node"], "left").join(r, [*keys, "ref"], "left")
    unknown = F.col("node_page").isNull() | (F.col("ref").isNotNull() & F.col("ref_page").isNull())
    context = F.col("node_context") | (F.coalesce("ref_context", F.lit(False)) & (F.col("op") != "merge_flow"))
    rules = (
        F.when(unknown, "REJECT_UNKNOWN_ID")
        .when(context, "REJECT_CONTEXT_TARGET")
        .when(F.col("ref").isNotNull() & (F.col("node_page") != F.col("ref_page")), "REJECT_PAGE_CROSS")
        .when(F.col("confidence_pm") < LEAST_CONFIDENCE, "REJECT_CONFIDENCE")
        .when(F.col("votes") < LEAST_VOTES, "REJECT_MAJORITY")
        .otherwise("ACCEPT")
    )
    return j.select(*keys, "op", "node", "ref", "votes", rules.alias("verdict"))
