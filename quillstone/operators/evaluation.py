"""Agreement of labels, recall with intervals, funnels, novelty and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a proportion; (0, 1) for none."""
    p = hits / n
    denominator = 1 + z * z / n
    centre, margin = p + z * z / (2 * n), F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - margin) / denominator)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), (centre + margin) / denominator)).otherwise(1.0)


def precision_recall(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; with nothing predicted and nothing true all are 1, with one of both missing 0."""
    empty = (tp + fp + fn) == 0
    p = F.when(empty, 1.0).when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp))
    r = F.when(empty, 1.0).when(tp + fn == 0, 0.0).otherwise(tp / (tp + fn))
    return p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def stage_counts(rows: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, n_true, n_false, n_unknown) of boolean columns, null being unknown."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("v")) for s in stages))).alias("x")).select("x.*")
    return long.groupBy("stage").agg(F.count_if("v").alias("n_true"), F.count_if(~F.col("v")).alias("n_false"), F.count_if(F.col("v").isNull()).alias("n_unknown"))


def deepest_stage(stages: list[str]) -> Column:
    """The last of the stages that are true without a break from the first; NONE if the first isn't."""
    chain = None
    for i in range(len(stages), 0, -1):
        reached = F.lit(True)
        for s in stages[:i]:
            reached = reached & F.coalesce(F.col(s), F.lit(False))
        chain = F.when(reached, stages[i - 1]) if chain is None else chain.when(reached, stages[i - 1])
    return chain.otherwise("NONE")


def any_stage(rows: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """Per key: true if any row reached the stage, null if no row says."""
    return rows.groupBy(key).agg(*(F.bool_or(s).alias(s) for s in stages))


def novelty(rows: DataFrame, order: str, label: str) -> DataFrame:
    """(order, n_new, n_so_far): labels first seen at each step and in all so far; the steps are few, the rows may be many."""
    first = rows.where(F.col(label).isNotNull() & F.col(order).isNotNull()).groupBy(label).agg(F.min(order).alias("first"))
    new = first.groupBy(F.col("first").alias(order)).agg(F.count(F.lit(1)).alias("n"))
    steps = rows.where(F.col(order).isNotNull()).select(order).distinct().join(new, order, "left").select(order, F.coalesce("n", F.lit(0)).alias("n_new"))
    return steps.withColumn("n_so_far", F.sum("n_new").over(Window.orderBy(order)))


# Forms by what is done with them
ITEMIZED = ("8-K", "8-K/A")
LONG = ("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A", "6-K", "6-K/A")
DEAL_FORMS = ("10-Q", "10-Q/A", "10-QT", "10-KT", "10-KT/A", "10-K405", "S-4", "S-4/A", "F-4", "F-4/A", "425", "DEFM14A", "PREM14A", "DEFA14A", "SC TO-T", "SC TO-T/A", "SC TO-I", "SC 14D9", "SC 14D9/A", "SC 13E3")


def disposition(form: Column, items: Column) -> Column:
    """What retrieval does with a filing, by its form and the items that it reports."""
    return (
        F.when(form.isin(*ITEMIZED), F.when(F.coalesce(F.trim(items), F.lit("")) == "", "skipped_no_item_metadata").when(F.contains(items, F.lit("1.01")) | F.contains(items, F.lit("2.01")), "fetched_item_gated").otherwise("skipped_item_gate"))
        .when(form.isin(*LONG), "fetched_via_locator")
        .when(form.isin(*DEAL_FORMS), "skipped_unsupported_deal_relevant")
        .otherwise("skipped_unsupported_other")
    )
