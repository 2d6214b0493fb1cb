"""Ranking, retrieval, models, sources and sinks on hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillrank.operators import beyond, bm25, bootstrap, dense, metrics, nrms, rerank, submit
from rillrank.sources import array_layout, tab_layout, tables

SCORED = "impression_id string, article_id string, position int, score double, clicked int"


def test_cap_top_k(spark):
    rows = [("i1", a, i, s, 0) for i, (a, s) in enumerate([("a", 0.9), ("b", 0.1), ("c", 0.5), ("d", 0.3)])]
    rows += [("i2", "e", 0, 0.2, 0), ("i2", "f", 1, 0.8, 0)]
    out = metrics.cap_top_k(spark.createDataFrame(rows, SCORED), "score", 2).collect()
    assert {(r.impression_id, r.article_id) for r in out} == {("i1", "a"), ("i1", "c"), ("i2", "e"), ("i2", "f")}


def test_degenerate_impressions_are_left_out(spark):
    rows = [("i1", "a", 0, 0.9, 1), ("i1", "b", 1, 0.1, 0), ("i2", "a", 0, 0.5, 0), ("i2", "b", 1, 0.4, 0), ("i3", "a", 0, 0.5, 1), ("i4", "a", 0, 0.1, 1), ("i4", "b", 1, 0.2, 1)]
    out = {r.impression_id: r for r in metrics.evaluate_scores(spark.createDataFrame(rows, SCORED), "score").collect()}
    assert set(out) == {"i1", "i4"} and out["i1"].auc == 1.0 and out["i4"].auc is None


def test_metrics_by_hand(spark):
    rows = [("i", x, p, s, c) for x, p, s, c in [("a", 0, 0.5, 0), ("b", 1, 0.5, 1), ("c", 2, 0.9, 0), ("d", 3, 0.1, 1)]]
    r = metrics.evaluate_scores(spark.createDataFrame(rows, SCORED), "score").first()
    assert r.auc == pytest.approx((0.5 + 0 + 0 + 0) / 4)
    assert r.mrr == pytest.approx(1 / 3)
    assert r.ndcg5 == pytest.approx((1 / np.log2(4) + 1 / np.log2(5)) / (1 + 1 / np.log2(3)))


def test_ranker_learns_a_label_like_feature(spark):
    random = np.random.default_rng(0)
    rows = []
    for i in range(200):
        n = int(random.integers(3, 8))
        hit = int(random.integers(n))
        rows += [(f"i{i}", f"{i}:{j}", f"a{j}", j, int(j == hit), float((j == hit) + random.normal(0, 0.01)), float(random.normal())) for j in range(n)]
    table = spark.createDataFrame(rows, "impression_id string, row_id string, article_id string, position int, clicked int, bm25_score double, noise double")
    columns = ("bm25_score", "noise")
    ranker = rerank.train_ranker(table, columns=columns, trees=3, rate=0.3)
    scored = ranker.score(table, columns=columns)
    best = metrics.cap_top_k(scored, "rank_score", 1).agg(F.avg("clicked")).first()[0]
    assert best > 0.9


def test_bm25_unknown_and_empty(spark):
    texts = spark.createDataFrame([("1", "red red fox"), ("2", "blue fox"), ("3", None), ("4", "")], "article_id string, text string")
    index = bm25.postings(texts)
    terms = bm25.query_terms(spark.createDataFrame([("q", "fox fox RED zebra"), ("r", "zebra"), ("s", None)], "query_id string, text string"))
    top = bm25.top_k(terms, index, 5).collect()
    assert [(r.query_id, r.article_id) for r in sorted(top, key=lambda r: r["rank"])] == [("q", "1"), ("q", "2")]
    pairs = spark.createDataFrame([("q", "1"), ("q", "9"), ("r", "1")], "query_id string, article_id string")
    assert sorted((r.query_id, r.article_id, r.bm25_score > 0) for r in bm25.score_pairs(pairs, terms, index, query_col="query_id").collect()) == [
        ("q", "1", True), ("q", "9", False), ("r", "1", False)]


def test_bm25_topk_asks_every_fiftieth_document(spark, tmp_path, monkeypatch):
    import math
    import random
    from collections import Counter

    from rillrank.queries import QUERIES

    r = random.Random(5)
    texts = {i: " ".join(f"w{int(r.expovariate(0.1))}" for _ in range(r.randrange(1, 40))) for i in range(2, 202)}
    texts[100], texts[3] = None, texts[50]  # a query without terms, and a copy that ties with a query
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(bm25, "BLOCK_POSTINGS", 500)
    monkeypatch.setattr(bm25, "GROUP_TERMS", 30)
    words = {i: (t or "").split() for i, t in texts.items()}
    df = Counter(w for ws in words.values() for w in set(ws))
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for q in (i for i in words if i % 50 == 0):
        scores = {}
        for i, ws in words.items():
            tf = Counter(ws)
            shared = sorted(set(words[q]) & set(ws))
            if shared:
                norm = 1.5 * (0.25 + 0.75 * len(ws) / mean)
                scores[str(i)] = sum(math.log((len(words) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + norm) for w in shared)
        for rank, (i, score) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:20], 1):
            want[str(q), i] = (rank, pytest.approx(score, abs=2e-6))
    got = {(x.query_id, x.article_id): (x["rank"], x.score) for x in QUERIES["bm25_topk"](spark, str(tmp_path)).collect()}
    assert {q for q, _ in got} == {"50", "150", "200"} and got == want


def test_dense_top_k_keeps_negatives_in_blocks(spark, monkeypatch):
    random = np.random.default_rng(1)
    vec = random.normal(size=(50, 8))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(vec)], "article_id string, vec array<double>")
    queries = spark.createDataFrame([("q", vec[7].tolist())], "who string, history_vec array<double>")
    monkeypatch.setattr(dense, "BLOCK_ROWS", 16)
    out = dense.top_k(queries, vectors, 50, query_col="who").orderBy("rank").collect()
    want = np.argsort(-(vec @ vec[7]), kind="stable")
    assert [r.article_id for r in out] == [str(i) for i in want] and out[0].article_id == "7" and out[-1].score < 0


def test_serve_batch_serves_in_the_rankers_order(spark):
    from rillrank.queries import QUERIES

    served = {}
    for r in QUERIES["serve_batch"](spark, "/root/testdata/sf0.001").select("who", "retrieval_rank", "rank_score", "rank").collect():
        served.setdefault(r.who, []).append((r["rank"], -r.rank_score, r.retrieval_rank))
    for rows in served.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    # The second stage changes the order of retrieval.
    assert any([r[2] for r in rows] != sorted(r[2] for r in rows) for rows in served.values())


def test_beyond_accuracy(spark):
    lists = spark.createDataFrame([("i", "a"), ("i", "b"), ("j", "a")], "impression_id string, article_id string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "article_id string, vec array<double>")
    out = {r.impression_id: r.diversity for r in beyond.diversity(lists, vectors).collect()}
    assert out["i"] == pytest.approx(1.0) and out["j"] is None
    pop = spark.createDataFrame([("a", 3)], "article_id string, clicks long")
    nov = {r.impression_id: r.novelty for r in beyond.novelty(lists, pop).collect()}
    assert nov["j"] == pytest.approx(-np.log2(4 / 5)) and nov["i"] == pytest.approx((-np.log2(4 / 5) - np.log2(1 / 5)) / 2)
    assert beyond.coverage(lists, lists.limit(0)).first().coverage == 0.0


def test_bootstrap(spark):
    values = spark.createDataFrame([("k", str(i), float(i % 5)) for i in range(100)] + [("e", "0", None)], "key string, row_id string, value double")
    out = {r.key: r for r in bootstrap.bootstrap_ci(values, keys=("key",), rounds=200).collect()}
    assert out["k"].lower < 2.0 < out["k"].upper and out["k"].mean == 2.0
    assert out["e"].n == 0 and out["e"].mean is None
    near = bootstrap.poisson_ci(values.where("key = 'k'"), keys=("key",), rounds=200).first()
    assert near.lower == pytest.approx(out["k"].lower, abs=0.15) and near.upper == pytest.approx(out["k"].upper, abs=0.15)


def test_submission_line(spark):
    rows = [("7", "a", 0, 0.1, 0), ("7", "b", 1, 0.9, 0), ("7", "c", 2, 0.9, 0)]
    assert submit.submission_lines(spark.createDataFrame(rows, SCORED), "score").first().line == "7 [3,1,2]"


def test_tab_layout(spark, tmp_path):
    (tmp_path / "news.tsv").write_text('N1\tsports\tgolf\tA "title\tabs\tu\t[]\t[{"x": 1}]\nN2\tnews\t\t\t\tu\t\t\n')
    (tmp_path / "news2.tsv").write_text("N1\tother\tgolf\tLater\tabs\tu\t[]\t[]\n")
    (tmp_path / "b.tsv").write_text("1\tU1\t11/15/2019 9:05:58 AM\tN1 N2\tN3-0 N4-1 bad\n2\tU2\t11/15/2019 12:00:00 PM\t\tN3-1\n")
    arts, shown, past = tab_layout.load(spark, [(str(tmp_path / "news.tsv"), str(tmp_path / "b.tsv")), (str(tmp_path / "news2.tsv"), str(tmp_path / "b.tsv"))], dataset="m")
    assert {(r.article_id, r.title) for r in arts.collect()} == {("N1", 'A "title'), ("N2", None)}
    rows = sorted((r.impression_id, r.position, r.article_id, r.clicked) for r in shown.collect())
    assert rows[:3] == [("m:0:1", 0, "N3", 0), ("m:0:1", 1, "N4", 1), ("m:0:2", 0, "N3", 1)] and len(rows) == 6
    assert past.count() == 4 and past.where("us is null").count() == 0


def test_array_layout(spark):
    import datetime

    t = datetime.datetime(2023, 5, 1, 12)
    raw = spark.createDataFrame(
        [(1, 5, t, [7, 8], [8], 3, 1.5), (2, 5, t, None, None, 3, None), (3, 5, t, [7], None, 3, None)],
        "impression_id int, user_id int, impression_time timestamp_ntz, article_ids_inview array<int>, article_ids_clicked array<int>, session_id int, read_time float",
    )
    out = sorted((r.impression_id, r.article_id, r.clicked, r.position) for r in array_layout.impressions(raw, dataset="e").collect())
    assert out == [("e:1", "7", 0, 0), ("e:1", "8", 1, 1), ("e:3", "7", 0, 0)]
    past = spark.createDataFrame([(5, [1, 2, 3], [t, t])], "user_id int, article_id_fixed array<int>, impression_time_fixed array<timestamp_ntz>")
    assert [(r.article_id, r.hist_pos) for r in array_layout.history(past, dataset="e").collect()] == [("1", 0), ("2", 1)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("i", "d", "train", 1), ("j", "d", "val", 2)], "impression_id string, dataset string, split string, x int")
    tables.save(df, str(tmp_path / "t"), by=("dataset", "split"))
    assert tables.read_columns(spark, str(tmp_path / "t"), ("impression_id",), split="val").collect()[0][0] == "j"
    assert tables.load_if_there(spark, str(tmp_path / "none")) is None
    assert tables.sample_impressions(df, 1).count() == 2


def test_vocabulary_and_titles(spark):
    titles = spark.createDataFrame([("1", "Big news big"), ("2", "other words here now"), ("3", None)], "key string, title string")
    vocab = nrms.vocabulary(titles, size=4)
    assert {r.term: r.id for r in vocab.collect()} == {"big": 2, "here": 3}
    out = {r.key: r.ids for r in nrms.encode_titles(titles, vocab, key="key", length=3).collect()}
    assert out == {"1": [2, 1, 2], "2": [1, 1, 3], "3": [0, 0, 0]}


def test_registered_vocabulary_holds_more_than_a_thousand_terms(spark, tmp_path):
    from rillrank.queries import QUERIES

    rows = [(i, f"w{i:04d}") for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["vocab"](spark, str(tmp_path)).count() == 1500
    ids = {r.ids.split(",")[0] for r in QUERIES["encode_titles"](spark, str(tmp_path)).collect()}
    assert ids == {str(i) for i in range(2, 1502)}


def test_nrms_guards_and_learns():
    model = nrms.Nrms(10, 3, width=16, heads=4)
    assert np.isfinite(model.encode_news(np.zeros((3, 10), int), np.zeros(3, int)).value).all()
    out = model.encode_user(np.zeros((2, 5, 4), int), np.zeros((2, 5), int), np.zeros((2, 5), bool))
    assert out.value.shape == (2, 16) and np.isfinite(out.value).all()
    random = np.random.default_rng(0)
    batch = {
        "hist_ids": random.integers(0, 10, (4, 3, 6)), "hist_cats": random.integers(0, 3, (4, 3)), "hist_mask": np.ones((4, 3), bool),
        "ids": random.integers(0, 10, (4, 6)), "cat": random.integers(0, 3, 4), "label": np.array([1.0, 0, 1, 0]),
    }
    losses = model.train(lambda: iter([batch]), epochs=20, rate=0.05)
    assert losses[-1] < losses[0]


def test_nrms_gradient_is_the_slope():
    model = nrms.Nrms(6, 2, width=8, heads=2)
    batch = {"hist_ids": np.array([[[2, 3], [4, 0]]]), "hist_cats": np.array([[1, 0]]), "hist_mask": np.array([[True, True]]), "ids": np.array([[5, 2]]), "cat": np.array([1])}
    z = model.logits(batch)
    z.backward()
    node = model.p["user_q"]
    got, kept = node.grad[1, 2], node.value.copy()
    node.value = kept.copy(); node.value[1, 2] += 1e-5
    up = model.logits(batch).value[0]
    node.value = kept.copy(); node.value[1, 2] -= 1e-5
    down = model.logits(batch).value[0]
    assert got == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-8)


def test_negative_sample_leaves_out_impressions_without_a_click(spark):
    rows = [("i1", f"a{j}", j, int(j == 2)) for j in range(8)] + [("i2", f"a{j}", j, 0) for j in range(6)]
    out = nrms.negative_sample(spark.createDataFrame(rows, "impression_id string, article_id string, position int, clicked int")).collect()
    assert len(out) == 5 and {r.impression_id for r in out} == {"i1"} and sum(r.clicked for r in out) == 1


def test_examples_keep_unknown_articles(spark):
    articles = spark.createDataFrame([("a1", "red fox", "animals")], "article_id string, title string, category string")
    shown = spark.createDataFrame([("i", "a1", 0, 1), ("i", "zz", 1, 0)], "impression_id string, article_id string, position int, clicked int")
    clicks = spark.createDataFrame([("i", ["zz", "a1"])], "impression_id string, recent_article_ids array<string>")
    out = {r.article_id: r for r in nrms.examples(shown, clicks, articles, nrms.vocabulary(articles), nrms.category_vocabulary(articles), length=3).collect()}
    assert out["zz"].ids == [0, 0, 0] and out["zz"].cat == 0 and out["a1"].cat == 1
    assert out["a1"].hist_ids[0] == [0, 0, 0] and out["a1"].hist_cats == [0, 1]


def test_few_fails_beyond_its_bound(spark):
    from pyspark.errors import PySparkException

    from rillrank.functions.columns import few

    assert few(spark.range(5), 5).count() == 5 and few(spark.range(0), 5).count() == 0
    with pytest.raises(PySparkException, match="more than 5 rows"):
        few(spark.range(6), 5).collect()


def test_split_moves_no_impressions(spark):
    from rillrank.operators import split

    shown = spark.range(1000).selectExpr("'d' as dataset", "id * 86400000000 as us", "id")
    out = split.temporal_split(shown, {}, (1, 1))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(dataset" not in plan.split("BroadcastExchange")[0]
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"test": 2, "val": 1, "train": 997}


def test_embed_and_cached_vectors(spark, tmp_path):
    texts = spark.createDataFrame([("1", "aa b"), ("2", None)], "article_id string, text string")
    path, made = str(tmp_path / "vectors"), []

    def make():
        made.append(1)
        return dense.embed(texts, lambda batch: np.array([[t.count("a"), t.count("b")] for t in batch]))

    for _ in range(2):
        got = {r.article_id: r.vec for r in tables.cached_vectors(spark, path, make).collect()}
    assert len(made) == 1 and got["2"] == [0.0, 0.0] and got["1"] == pytest.approx([2 / 5**0.5, 1 / 5**0.5])


def test_build_and_reports(spark, tmp_path):
    from rillrank.plans import adapters, runs

    d = "/root/testdata/sf0.001"
    paths = runs.build(adapters.impressions(spark, d), adapters.history(spark, d), adapters.articles(spark, d), str(tmp_path), days={"even": (60, 60), "odd": (120, 120)})
    features = spark.read.parquet(paths["behavioral"])
    assert features.count() == adapters.impressions(spark, d).count()
    scored = features.withColumn("noise", F.rand(1)).withColumn("best", F.col("clicked").cast("double"))
    out = {(r.split, r.stage, r.metric): r for r in runs.before_and_after(scored.where("split != 'train'"), "noise", "best").collect()}
    assert out["test", "after", "mrr"].mean == 1.0 and out["test", "before", "mrr"].lower < out["test", "before", "mrr"].mean < 1.0
    clicks = features.groupBy("impression_id").agg(F.first("is_cold_start").alias("is_cold_start"))
    whole = runs.full_evaluation(scored, {"noise": "noise", "best": "best"}, clicks, adapters.articles(spark, d), adapters.vectors(spark, d)).collect()
    assert {r.metric for r in whole} == {"auc", "mrr", "ndcg5", "ndcg10", "diversity", "novelty", "coverage"}
    n = {(r["slice"], r.split): r.n for r in whole if r.method == "best" and r.metric == "mrr"}
    for part in ("val", "test"):
        assert n["overall", part] == n.get(("cold", part), 0) + n.get(("warm", part), 0) == n.get(("head", part), 0) + n.get(("tail", part), 0)
