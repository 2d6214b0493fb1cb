"""Per-impression ranking metrics and their summaries.

A scored table has one row per candidate: impression_id, position, clicked and a score column.  Ties of the score
follow the position wherever an order is needed; AUC gives tied scores their average rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank.cast("double") + 1.0)


def _ideal(positives: Column, k: int) -> Column:
    """Gain of ``min(positives, k)`` leading hits."""
    last = F.least(positives.cast("int"), F.lit(k))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), F.lit(0.0), lambda s, i: s + _gain(i))


def evaluate_scores(scored: DataFrame, score: str, *, label: str = "clicked", keys: tuple[str, ...] = ("impression_id",)) -> DataFrame:
    """``auc, mrr, ndcg5, ndcg10`` per impression; fewer than two candidates or no click: no row; all clicked: null AUC.

    Both rankings share one shuffle and one sort on the impression; then one aggregation.
    """
    # One sort serves the three windows: scores fall as ``_at`` rises (null scores last, NaN first, as in a descending
    # order), and the average rank from below follows from the one from above.
    place = F.when(F.col(score).isNull(), 2).when(F.isnan(score), 0).otherwise(1)
    placed = scored.withColumn("_of", place).withColumn("_at", F.when(F.col("_of") == 1, F.lit(0.0) - F.col(score)).otherwise(F.lit(0.0)))
    group = Window.partitionBy(*keys)
    ranked = (
        placed.withColumn("_rank", F.row_number().over(group.orderBy("_of", "_at", "position")))
        .withColumn("_high", F.rank().over(group.orderBy("_of", "_at")))
        .withColumn("_ties", F.count(F.lit(1)).over(group.orderBy("_of", "_at").rangeBetween(Window.currentRow, Window.currentRow)))
    )
    hit = F.col(label) == 1
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(label).alias("p"),
        F.sum(F.when(hit, F.col("_high") + (F.col("_ties") - 1) / 2)).alias("from_above"),
        F.min(F.when(hit, F.col("_rank"))).alias("first_hit"),
        *(F.coalesce(F.sum(F.when(hit & (F.col("_rank") <= k), _gain(F.col("_rank")))), F.lit(0.0)).alias(f"dcg{k}") for k in (5, 10)),
    ).where("n >= 2 and p > 0").withColumn("rank_sum", F.col("p") * (F.col("n") + 1) - F.col("from_above"))
    pairs = F.col("p") * (F.col("n") - F.col("p"))
    auc = (F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(pairs.cast("double"), F.lit(0.0))
    return out.select(
        *keys, auc.alias("auc"), (F.lit(1.0) / F.col("first_hit")).alias("mrr"),
        *((F.col(f"dcg{k}") / _ideal(F.col("p"), k)).alias(f"ndcg{k}") for k in (5, 10)),
    )


def minmax(scored: DataFrame, score: str, out: str, *, keys: tuple[str, ...] = ("impression_id",)) -> DataFrame:
    """The score scaled to 0..1 within its impression; zeros where the range is below 1e-12."""
    group = Window.partitionBy(*keys)
    low, span = F.min(score).over(group), F.max(score).over(group) - F.min(score).over(group)
    return scored.withColumn(out, F.when(span >= 1e-12, (F.col(score) - low) / span).otherwise(F.lit(0.0)))


def hybrid(scored: DataFrame, alpha: float, *, lexical: str = "bm25_norm", dense: str = "semantic_norm") -> DataFrame:
    """``alpha`` times the lexical score plus the rest of the dense one."""
    return scored.withColumn("hybrid", F.lit(alpha) * F.col(lexical) + F.lit(1 - alpha) * F.col(dense))


def alpha_sweep(scored: DataFrame, alphas: tuple[float, ...], *, lexical: str = "bm25_norm", dense: str = "semantic_norm") -> DataFrame:
    """Mean metrics per alpha, and which alpha has the best AUC (the first of equals)."""
    mixed = scored.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).withColumn(
        "hybrid", F.col("alpha") * F.col(lexical) + (F.lit(1.0) - F.col("alpha")) * F.col(dense)
    )
    judged = evaluate_scores(mixed, "hybrid", keys=("alpha", "impression_id"))
    means = judged.groupBy("alpha").agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in ("auc", "mrr", "ndcg5", "ndcg10"))
    )
    # One row per alpha.
    best = Window.orderBy(F.desc(F.round("auc", 9)), "alpha")
    return means.withColumn("best", F.row_number().over(best) == 1)


def cap_top_k(scored: DataFrame, score: str, k: int, *, keys: tuple[str, ...] = ("impression_id",)) -> DataFrame:
    """Each impression's ``k`` best candidates; equal scores follow position, then article."""
    at = Window.partitionBy(*keys).orderBy(F.desc(score), "position", "article_id")
    return scored.withColumn("_rank", F.row_number().over(at)).where(F.col("_rank") <= k).drop("_rank")


def ranks(scored: DataFrame, score: str, *, keys: tuple[str, ...] = ("impression_id",)) -> DataFrame:
    """Adds the 1-based rank of every candidate."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "position")))


def by_slice(judged: DataFrame, slices: dict[str, Column], metrics: tuple[str, ...] = ("auc", "mrr", "ndcg5", "ndcg10")) -> DataFrame:
    """Long table of slice, metric, n and mean; a row counts in every slice whose condition holds."""
    named = F.array(*(F.when(c, F.lit(n)) for n, c in slices.items()))
    kept = judged.withColumn("slice", F.explode(F.filter(named, lambda n: n.isNotNull())))
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return kept.select("slice", values.alias("m")).groupBy("slice", F.col("m.metric").alias("metric")).agg(
        F.count("m.value").alias("n"), F.avg("m.value").alias("mean")
    )


def hit_rates(
    retrieved: DataFrame, truth: DataFrame, ks: tuple[int, ...], *, keys: tuple[str, ...] = ("impression_id",), by: tuple[str, ...] = ()
) -> DataFrame:
    """Share of scored impressions with any clicked article among their first k, in all or by columns of ``truth``.

    ``retrieved``: keys, article_id, rank; impressions are those of ``truth`` that were asked (column ``asked``).
    """
    found = retrieved.join(truth.select(*keys, "article_id"), [*keys, "article_id"]).groupBy(*keys).agg(F.min("rank").alias("first"))
    asked = truth.where("asked").select(*keys, *by).distinct()
    return asked.join(found, list(keys), "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")).alias(f"hit_rate_{k}") for k in ks),
    )
