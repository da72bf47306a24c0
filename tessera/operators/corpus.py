"""Sampling, mixing and in-batch deduplication of training samples, and contrastive losses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.ids import order_key


def sample_per_group(rows: DataFrame, keys: list[str], id: str, n: int, seed: int = 42) -> DataFrame:  # noqa: A002
    """At most n rows a group without replacement, by smallest seeded hash. A filter on the window's rank keeps it partial in each task."""
    w = Window.partitionBy(*keys).orderBy(order_key(F.col(id), seed=seed), id)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def first_per_group(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """At most n rows a group, in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def weighted_choice(weights: DataFrame, steps: DataFrame, seed: int = 42) -> DataFrame:
    """step, name: for each step a data set, each as likely as its weight.

    weights(name, weight int) is a configuration of a few rows; each name is repeated by its weight in name order, and the
    step's hash picks a place.
    """
    names = weights.orderBy("name").select("name", "weight").collect()
    slots = [r["name"] for r in names for _ in range(r["weight"])]
    h = F.conv(F.substring(order_key(F.col("step"), seed=seed), 1, 8), 16, 10).cast("long")
    return steps.select("step", F.element_at(F.array(*[F.lit(s) for s in slots]), (F.pmod(h, F.lit(len(slots))) + 1).cast("int")).alias("name"))


def weighted_sample(rows: DataFrame, id: str, weight: str, n: int, seed: int = 42) -> DataFrame:  # noqa: A002
    """n rows without replacement, likelier by weight: the largest keys u ** (1 / weight), compared as ln(u) / weight."""
    u = (F.conv(F.substring(order_key(F.col(id), seed=seed), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(2**52))
    return rows.filter(F.col(weight) > 0).withColumn("_k", F.log(u) / F.col(weight)).orderBy(F.desc("_k"), id).limit(n).drop("_k")


def epoch_order(rows: DataFrame, id: str, epoch: int) -> DataFrame:  # noqa: A002
    """rows in the seeded order of an epoch, with their place; sorted by ranges, not in one task."""
    from tessera.operators.knn import numbered_rows

    return numbered_rows(rows.withColumn("_k", order_key(F.col(id), seed=epoch)), "_k", id).withColumn("position", F.col("_row") + 1).drop("_k", "_row")


def unique_in_batch(samples: DataFrame, batch: str, order: str, texts: str = "texts") -> DataFrame:
    """samples that share no text with an earlier accepted sample of their batch; a rejected one is used up.

    The rule is greedy, so a batch is walked in order; a batch is bounded by its size.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        keep = []
        for t in pdf.sort_values(order)[texts]:
            new = not any(x in seen for x in t)
            keep.append(new)
            if new:
                seen.update(t)
        return pdf.sort_values(order)[keep]

    return samples.groupBy(batch).applyInPandas(walk, samples.schema)


def _log_sum_exp(c: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    top = F.max(c).over(w)
    return F.log(F.sum(F.exp(c - top)).over(w)) + top


def clip_loss(logits: DataFrame, *by: str) -> DataFrame:
    """by, loss: symmetric cross entropy over the logits(by, i, j, logit) of each batch, where i matches j = i."""
    z = F.col("logit")
    each = logits.withColumn("_r", _log_sum_exp(z, *by, "i") - z).withColumn("_c", _log_sum_exp(z, *by, "j") - z).filter("i = j")
    return each.groupBy(*by).agg(((F.avg("_r") + F.avg("_c")) / 2).alias("loss"))


def siglip_loss(logits: DataFrame, *by: str) -> DataFrame:
    """by, loss: sigmoid loss of all pairs of a batch, matches positive, divided by its images."""
    y = F.when(F.col("i") == F.col("j"), 1.0).otherwise(-1.0)
    return logits.groupBy(*by).agg((F.sum(F.log1p(F.exp(-y * F.col("logit")))) / F.countDistinct("i")).alias("loss"))


def distill_loss(logits: DataFrame, *by: str) -> DataFrame:
    """by, loss: cross entropy of the student's rows under the teacher's softmax. logits: by, i, j, logit, teacher."""
    p = F.exp(F.col("teacher") - _log_sum_exp(F.col("teacher"), *by, "i"))
    each = logits.withColumn("_l", -p * (F.col("logit") - _log_sum_exp(F.col("logit"), *by, "i")))
    return each.groupBy(*by).agg((F.sum("_l") / F.countDistinct("i")).alias("loss"))


def weighted_loss(contrastive: DataFrame, captions: DataFrame, by: str, weights: tuple[float, float] = (1.0, 2.0)) -> DataFrame:
    """by, loss: the contrastive loss of a batch and the mean cross entropy of its caption tokens(by, logit of the token, log_sum), weighted.

    Padding tokens (those with a null token) count nothing.
    """
    told = captions.filter(F.col("token").isNotNull()).groupBy(by).agg(F.avg(F.col("log_sum") - F.col("logit")).alias("_c"))
    return contrastive.join(told, by, "left").select(by, (F.lit(weights[0]) * F.col("loss") + F.lit(weights[1]) * F.coalesce("_c", F.lit(0.0))).alias("loss"))


def pair_logits(images: DataFrame, texts: DataFrame, batch: str, scale: float = 20.0, bias: float = 0.0) -> DataFrame:
    """batch, i, j, logit: scaled dot products of images(batch, i, a) with the texts(batch, j, b) of their batch."""
    from tessera.functions.vector import dot

    return images.join(texts, batch).select(batch, "i", "j", (dot(F.col("a"), F.col("b")) * scale + bias).alias("logit"))
