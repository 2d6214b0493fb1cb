"""Shared steps at size: what moves, is sorted or is computed once stays so, and results stay those of the plain way."""

import re

from pyspark.sql import functions as F

from rillrank.functions.columns import held, normalised
from rillrank.operators import behavioral as bh
from rillrank.operators import bm25, dense, metrics, rerank
from rillrank.plans import adapters
from rillrank.plans.scratch import written

SF = "/root/testdata/sf0.001"


def count(df, node):
    return len(re.findall(node, df._jdf.queryExecution().executedPlan().toString()))


def test_norm_is_computed_once_a_vector(spark):
    row = spark.range(1).select(held(F.rand(), lambda x: F.transform(F.sequence(F.lit(1), F.lit(9)), lambda _: x)).alias("r")).first()
    assert len(set(row.r)) == 1
    plan = spark.range(1).select(normalised(F.array(F.col("id"), F.lit(2))).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1 and "/ lambda" in plan


def test_metrics_sort_once(spark):
    shown = adapters.impressions(spark, SF).withColumn("score", F.rand(1))
    assert count(metrics.evaluate_scores(written(shown), "score"), r"\bSort \[") == 1


def test_metrics_of_odd_scores(spark):
    nan, null, minus = float("nan"), None, -0.0
    rows = [("i", p, c, s) for p, c, s in [(0, 0, null), (1, 1, nan), (2, 0, 0.0), (3, 1, minus), (4, 0, null), (5, 1, 2.0)]]
    got = metrics.evaluate_scores(spark.createDataFrame(rows, "impression_id string, position int, clicked int, score double"), "score").first()
    # From above: NaN; 2.0; the two zeros; the two nulls.
    assert got.mrr == 1.0 and abs(got.auc - (6 + 5 + 3.5 - 6) / 9) < 1e-12


def test_candidates_move_once_to_their_article(spark):
    shown = written(adapters.impressions(spark, SF))
    assert count(bh.article_popularity(shown), r"Exchange hashpartitioning") == 1


def test_hot_articles_count_alike(spark, monkeypatch):
    shown = written(adapters.impressions(spark, SF).withColumn("us", F.when(F.col("position") != 2, F.col("us"))))
    columns = ("impression_id", "position", "article_id", "cum_clicks_prior", "cum_impressions_prior")
    plain = sorted(map(repr, bh.article_popularity(shown).select(*columns).collect()))
    monkeypatch.setattr(bh, "HOT_ROWS", 30)
    found = bh.article_popularity(shown)
    assert count(found, "Union") == 1
    assert sorted(map(repr, found.select(*columns).collect())) == plain


def test_clicks_and_impressions_meet_in_one_shuffle(spark):
    shown = written(adapters.impressions(spark, SF))
    found = bh.click_history(shown, adapters.clicks_of(shown))
    # One to find the impressions, one to bring them and the clicks to their user; no join.
    assert count(found, r"Exchange ") == 2 and count(found, "Join") == 0


def test_retrieval_scores_equal_the_pairwise_ones(spark):
    shown = written(adapters.impressions(spark, SF))
    history, vectors = adapters.clicks_of(shown), adapters.vectors(spark, SF)
    texts = adapters.articles(spark, SF).where("dataset = 'even'").select("article_id", F.concat_ws(" ", "title", "abstract").alias("text"))
    texts = written(texts)
    index = written(bm25.postings(texts))
    found = rerank.add_retrieval_scores(shown, history, texts, index, vectors)
    # A row per candidate and click throughout, none per term, dimension or recent click.
    assert count(found, "Generate") == 0
    clicks = bh.click_history(shown, history, n_recent=5)
    terms = bm25.history_queries(clicks, texts, id_col="impression_id", n_recent=5, ids="recent_article_ids")
    plain = bm25.score_pairs(shown, terms, index, query_col="impression_id")
    plain = dense.score_pairs(plain, bh.history_vectors(clicks, vectors), vectors, query_col="impression_id")
    both = [
        {(r.impression_id, r.position): (r.bm25_score, r.semantic_score) for r in t.select("impression_id", "position", "bm25_score", "semantic_score").collect()}
        for t in (found, plain)
    ]
    assert both[0].keys() == both[1].keys() and any(x[0] for x in both[0].values()) and any(x[1] for x in both[0].values())
    assert all(abs(a - b) < 1e-9 for k in both[0] for a, b in zip(both[0][k], both[1][k], strict=True))


def test_equal_documents_are_scored_once_and_keep_their_ranks(spark):
    texts = [(f"{i:03d}", t) for i, t in enumerate(["red ring", "red bolt", "blue ring", "red ring seven"] * 30)]
    index = written(bm25.postings(spark.createDataFrame(texts, "article_id string, text string")))
    asked = [("q1", "red"), ("q1", "ring"), ("q2", "blue"), ("q3", "seven"), ("q3", "bolt")]
    terms = spark.createDataFrame(asked, "query_id string, term string")
    few = bm25.folded(index, 35)
    assert few.select("article_id").distinct().count() == 120 - 0 * 4 and bm25.folded(index, 5).select("article_id").distinct().count() == 20
    weights = {(r.article_id, r.term): r.weight for r in index.collect()}
    for k in (5, 35):
        found = bm25.top_k(terms, bm25.folded(index, k), k)
        got = {q: [r.article_id for r in sorted(found.where(f"query_id = '{q}'").collect(), key=lambda r: r["rank"])] for q in ("q1", "q2", "q3")}
        for q in got:
            sums = {a: sum(weights.get((a, t), 0) for o, t in asked if o == q) for a, _ in texts}
            assert got[q] == sorted((a for a in sums if sums[a] > 0), key=lambda a: (-round(sums[a], 9), a))[:k]


def test_equal_query_vectors_are_asked_once(spark):
    vectors = spark.createDataFrame([(f"a{i}", [float(i), 1.0, -1.0]) for i in range(9)], "article_id string, vec array<double>")
    queries = spark.createDataFrame([(f"u{i}", [0.6, 0.8 * (i % 2), 0.0]) for i in range(40)], "who string, history_vec array<double>")
    found = dense.top_k(queries, vectors, 4, query_col="who")
    assert {r.who: r.n for r in found.groupBy("who").agg(F.count("rank").alias("n")).collect()} == {f"u{i}": 4 for i in range(40)}
    assert {r.article_id for r in found.where("rank = 1").collect()} == {"a8"}


def test_pairs_meet_their_terms_as_lists(spark):
    index = written(bm25.postings(spark.createDataFrame([("1", "a b"), ("2", "b c")], "article_id string, text string")))
    terms = spark.createDataFrame([("q", "a"), ("q", "c")], "query_id string, term string")
    pairs = spark.createDataFrame([("q", "1"), ("q", "2"), ("q", "3"), ("r", "1")], "query_id string, article_id string")
    found = bm25.score_pairs(pairs, terms, index, query_col="query_id")
    assert count(found, "Generate") == 0
    assert {(r.query_id, r.article_id): r.bm25_score > 0 for r in found.collect()} == {("q", "1"): True, ("q", "2"): True, ("q", "3"): False, ("r", "1"): False}


def test_tasks_of_a_boost_grow_one_tree(spark, monkeypatch):
    shown = adapters.impressions(spark, SF).withColumn("row_id", F.concat_ws(":", "impression_id", "position"))
    table = written(shown.withColumn("a", F.xxhash64("row_id") % 97 + 60 * F.col("clicked")).withColumn("b", F.xxhash64("row_id", F.lit(1)) % 11))
    alone = rerank.train_ranker(table, columns=("a", "b"), trees=3, rate=0.3)
    monkeypatch.setattr(rerank, "TASK_ROWS", 1000)
    shared = rerank.train_ranker(table, columns=("a", "b"), trees=3, rate=0.3)
    scores = [{r.row_id: r.rank_score for r in x.score(table, columns=("a", "b")).select("row_id", "rank_score").collect()} for x in (alone, shared)]
    assert len(set(scores[0].values())) > 3 and len(alone.trees) == len(shared.trees) == 3
    assert all(abs(scores[0][k] - scores[1][k]) < 1e-6 for k in scores[0])


def test_registered_ranker_has_all_trees(monkeypatch):
    from rillrank import queries

    asked = {}
    monkeypatch.setattr(rerank, "train_ranker", lambda table, **options: asked.update(options))
    queries._ranker(type("Table", (), {"where": lambda self, _: self})())
    assert asked == {}
