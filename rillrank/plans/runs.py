"""Composed runs: from click logs to feature tables, evaluation reports and ranked submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillrank import config
from rillrank.functions.columns import joined_text
from rillrank.operators import behavioral as bh
from rillrank.operators import beyond, bootstrap, metrics, nrms, rerank, split, store, submit
from rillrank.plans.scratch import written
from rillrank.sources.tables import save

METRICS = ("auc", "mrr", "ndcg5", "ndcg10")


def corpus(articles: DataFrame) -> DataFrame:
    """``article_id, text`` of title and abstract, one row per article."""
    return articles.groupBy("article_id").agg(F.min(joined_text(F.col("title"), F.col("abstract"))).alias("text"))


def build(
    impressions: DataFrame, history: DataFrame, articles: DataFrame, folder: str, *, days: dict[str, tuple[int, int]],
    default_days: tuple[int, int] = (1, 1), gap_minutes: float = config.SESSION_GAP_MINUTES,
) -> dict[str, str]:
    """Logs to tables: articles, users, impressions with their split, and behavioural features; paths by name.

    Impressions and features are partitioned by dataset and split.  Fails where a feature row sees the future.
    """
    paths = {name: f"{folder}/{name}" for name in ("articles", "users", "impressions", "behavioral")}
    spark = impressions.sparkSession
    save(split.temporal_split(impressions, days, default_days), paths["impressions"], by=("dataset", "split"))
    shown = spark.read.parquet(paths["impressions"])
    save(store.article_features(articles), paths["articles"])
    save(store.user_features(history, shown.where("split = 'train'")), paths["users"])
    save(bh.behavioral(shown, history, articles, gap_minutes=gap_minutes), paths["behavioral"], by=("dataset", "split"))
    bh.assert_no_leakage(spark.read.parquet(paths["behavioral"]))
    return paths


def report(judged: DataFrame, columns: tuple[str, ...], *, keys: tuple[str, ...], exact: bool = True) -> DataFrame:
    """``keys, metric, n, mean, lower, upper`` of the columns of a table with a row per impression (``row_id``)."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns)))
    table = judged.select(*keys, "row_id", values.alias("v")).select(*keys, "row_id", "v.metric", "v.value")
    return bootstrap.interval(table, keys=(*keys, "metric"), exact=exact)


def full_evaluation(
    scored: DataFrame, scores: dict[str, str], clicks: DataFrame, articles: DataFrame, vectors: DataFrame, *,
    evaluated: tuple[str, ...] = ("val", "test"), exact: bool = True,
) -> DataFrame:
    """``method, split, slice, metric, n, mean, lower, upper``: accuracy, diversity and novelty per slice, and coverage.

    ``scored`` holds candidates of all splits with the columns of ``scores`` (method to score column); popularity comes
    from its train split.  Accuracy counts all candidates, the rest each impression's best ``RECLIST_K``.  Slices are
    overall, cold and warm users, and head and tail by the train clicks of the clicked article.
    """
    methods = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("sc")) for m, c in scores.items())))
    shown = scored.where(F.col("split").isin(*evaluated)).select("impression_id", "split", "article_id", "position", "clicked", methods.alias("m"))
    shown = written(shown.select("impression_id", "split", "article_id", "position", "clicked", "m.method", F.round("m.sc", 9).alias("sc")), "methods")
    keys = ("method", "split", "impression_id")
    judged = metrics.evaluate_scores(shown, "sc", keys=keys)
    best = metrics.cap_top_k(shown, "sc", config.RECLIST_K, keys=keys).join(judged.select(*keys), list(keys), "left_semi")
    best = written(best.withColumn("list", F.struct(*keys)).select(*keys, "list", "article_id"), "lists")
    popularity = beyond.train_popularity(scored)
    heads = beyond.head_articles(popularity, config.HEAD_PERCENTILE)
    head = (
        shown.where("clicked = 1").select("impression_id", "article_id").distinct().join(heads, "article_id", "left")
        .groupBy("impression_id").agg(F.max(F.coalesce("head", F.lit(False))).alias("is_head"))
    )
    whole = (
        judged.withColumn("list", F.struct(*keys))
        .join(beyond.diversity(best, vectors, key="list"), "list", "left")
        .join(beyond.novelty(best, popularity, key="list"), "list", "left")
        .join(clicks.select("impression_id", "is_cold_start"), "impression_id", "left")
        .join(head, "impression_id", "left")
        .withColumnRenamed("impression_id", "row_id")
    )
    cold, known = F.col("is_cold_start"), F.coalesce("is_head", F.lit(False))
    slices = {"overall": F.lit(True), "cold": cold, "warm": ~cold, "head": known, "tail": ~known}
    cut = whole.withColumn("slice", F.explode(_names(slices)))
    measured = report(cut, (*METRICS, "diversity", "novelty"), keys=("method", "split", "slice"), exact=exact)
    size = articles.agg(F.count_distinct("article_id").alias("size"))
    covered = best.groupBy("method", "split").agg(F.count_distinct("article_id").alias("seen")).crossJoin(F.broadcast(size))
    none = F.lit(None).cast("double")
    coverage = covered.select(
        "method", "split", F.lit("overall").alias("slice"), F.lit("coverage").alias("metric"), F.col("seen").alias("n"),
        (F.col("seen") / F.nullif(F.col("size"), F.lit(0))).alias("mean"), none.alias("lower"), none.alias("upper"),
    )
    return measured.unionByName(coverage)


def _names(slices: dict[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in slices.items())), lambda n: n.isNotNull())


def before_and_after(scored: DataFrame, before: str, after: str, *, exact: bool = True) -> DataFrame:
    """``split, stage, metric, n, mean, lower, upper`` of two score columns of the evaluated splits."""
    judged = [
        metrics.evaluate_scores(scored, c, keys=("split", "impression_id")).withColumn("stage", F.lit(name))
        for name, c in (("before", before), ("after", after))
    ]
    both = judged[0].unionByName(judged[1]).withColumnRenamed("impression_id", "row_id")
    return report(both, METRICS, keys=("split", "stage"), exact=exact)


def neural_comparison(
    candidates: DataFrame, clicks: DataFrame, articles: DataFrame, *, length: int = 20, history: int = 20, exact: bool = True,
    max_words: int = 20_000, **training: object,
) -> DataFrame:
    """``split, model, metric, n, mean, lower, upper, significant``: titles only, with categories, and the paired difference.

    The vocabulary comes from the articles; both models learn from the same sampled train examples.
    """
    words, categories = nrms.vocabulary(articles, size=max_words), nrms.category_vocabulary(articles)
    rows = written(nrms.examples(candidates, clicks, articles, words, categories, length=length, history=history), "examples")
    train = nrms.negative_sample(rows.where("split = 'train'"))
    scored = rows.where("split != 'train'")
    sizes = {"words": words.count() + 2, "categories": categories.count() + 1}
    for name, use in (("titles", False), ("categories", True)):
        model, _ = nrms.train_model(train, length=length, history=history, use_category=use, **sizes, **training)
        scored = nrms.score_rows(scored, model, length=length, history=history, out=name)
    scored = written(scored.select("split", "impression_id", "article_id", "position", "clicked", "titles", "categories"), "neural")
    judged = {m: metrics.evaluate_scores(scored, m, keys=("split", "impression_id")).withColumnRenamed("impression_id", "row_id") for m in ("titles", "categories")}
    parts = [report(j.withColumn("model", F.lit(m)), METRICS, keys=("split", "model"), exact=exact) for m, j in judged.items()]
    pairs = judged["titles"].join(judged["categories"].select("split", "row_id", *(F.col(m).alias(f"b_{m}") for m in METRICS)), ["split", "row_id"])
    change = pairs.select("split", "row_id", F.lit("difference").alias("model"), *((F.col(f"b_{m}") - F.col(m)).alias(m) for m in METRICS))
    parts.append(report(change, METRICS, keys=("split", "model"), exact=exact))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    apart = (F.col("lower") > 0) | (F.col("upper") < 0)
    return found.withColumn("significant", F.when(F.col("model") == "difference", apart))


def hybrid_submission(
    asked: DataFrame, history: DataFrame, texts: DataFrame, index: DataFrame, vectors: DataFrame, *, alpha: float
) -> DataFrame:
    """``impression_id, line``: the unlabelled candidates of ``asked`` ranked by the mixed retrieval scores."""
    scored = rerank.add_retrieval_scores(asked, history, texts, index, vectors)
    scored = metrics.minmax(metrics.minmax(scored, "bm25_score", "bm25_norm"), "semantic_score", "semantic_norm")
    mixed = metrics.hybrid(scored, alpha).withColumn("hybrid", F.round("hybrid", 9))
    return submit.submission_lines(mixed, "hybrid")


def reranked_submission(
    asked: DataFrame, labelled: DataFrame, history: DataFrame, articles: DataFrame, texts: DataFrame, index: DataFrame,
    vectors: DataFrame, ranker: rerank.Ranker, *, gap_minutes: float = config.SESSION_GAP_MINUTES,
) -> DataFrame:
    """``impression_id, line``: the unlabelled candidates of ``asked`` ranked by a trained ranker.

    Click rates of articles and positions come from the labelled impressions, as ``asked`` has none; the other features
    are those of training.
    """
    shown = asked.drop("clicked").withColumn("clicked", F.lit(0))
    clicks = bh.click_history(shown, bh.with_attributes(history, articles, "category"), attributes=("category",))
    scored = rerank.add_retrieval_scores(shown, history, texts, index, vectors)
    features = bh.category_match(bh.freshness(scored, articles), clicks)
    scalars = clicks.select("impression_id", "n_clicks_before", "recency_weighted_click_count", "is_cold_start")
    visits = bh.sessions(shown, gap_minutes=gap_minutes).select(
        "impression_id", F.lit(0).alias("session_click_count_before"), "session_impressions_before", "avg_dwell_time_before"
    )
    rates = submit.popularity_prior(labelled).select("article_id", F.col("ctr").alias("popularity_prior_ctr"))
    places = submit.position_prior(labelled).select("position", F.col("ctr").alias("position_ctr_prior"))
    features = (
        features.join(scalars, "impression_id", "left").join(visits, "impression_id", "left")
        .join(rates, "article_id", "left").join(places, "position", "left")
    )
    return submit.submission_lines(ranker.score(features), "rank_score")
