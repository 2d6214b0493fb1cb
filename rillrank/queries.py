"""Registered queries of the engine's own operators and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import partial, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillrank import config
from rillrank.functions.columns import few, tokens
from rillrank.operators import behavioral as bh
from rillrank.operators import beyond, bm25, bootstrap, dense, metrics, nrms, rerank, serving, split, store, submit
from rillrank.plans import adapters, runs
from rillrank.plans.scratch import written
from rillrank.sources import array_layout, tab_layout
from rillrank.sql import judged, query, r6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The gap that the queries split sessions at: a month, as the data's orders are days apart.
GAP_MINUTES = 43200.0


#: Tables of the query that is being built: those that several of its steps read are made once.
_made: ContextVar[dict | None] = ContextVar("made", default=None)


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        @wraps(f)
        def run(s: SparkSession, d: str) -> DataFrame:
            token = _made.set({})
            try:
                return f(s, d)
            finally:
                _made.reset(token)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register


def _once(make: Query) -> Query:
    """The table made by the first call within a query."""

    @wraps(make)
    def made(s: SparkSession, d: str) -> DataFrame:
        held = _made.get()
        if held is None:
            return make(s, d)
        if (make.__name__, d) not in held:
            held[make.__name__, d] = make(s, d)
        return held[make.__name__, d]

    return made


def _r6(x: Column | str) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(1.3e-8), 6)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r6(c) for c in columns})


@_once
def _imp(s: SparkSession, d: str) -> DataFrame:
    """Impressions, written once: their candidates are sorted within each impression."""
    return written(adapters.impressions(s, d), "impressions", compression="zstd")


def _hist(s: SparkSession, d: str) -> DataFrame:
    return adapters.clicks_of(_imp(s, d))


@_once
def _split(s: SparkSession, d: str) -> DataFrame:
    return split.temporal_split(_imp(s, d), split.SPLIT_DAYS)


def _users(s: SparkSession, d: str) -> DataFrame:
    return store.user_features(_hist(s, d), _split(s, d).where("split = 'train'"))


def _clicks(s: SparkSession, d: str) -> DataFrame:
    return bh.click_history(_imp(s, d), _hist(s, d))


def _clicks_with_categories(s: SparkSession, d: str) -> DataFrame:
    return bh.click_history(_imp(s, d), bh.with_attributes(_hist(s, d), adapters.articles(s, d), "category"), attributes=("category",))


def _texts(s: SparkSession, d: str) -> DataFrame:
    return adapters.articles(s, d).where("dataset = 'even'").select("article_id", F.concat_ws(" ", "title", "abstract").alias("text"))


@_once
def _index(s: SparkSession, d: str) -> DataFrame:
    return written(bm25.postings(_texts(s, d)), "postings")


def _popular(s: SparkSession, d: str) -> DataFrame:
    return bh.article_popularity(_split(s, d)).withColumn("score", F.coalesce("popularity_prior_ctr", F.lit(0.0)))


@_once
def _both(s: SparkSession, d: str) -> DataFrame:
    return written(rerank.add_retrieval_scores(_split(s, d), _hist(s, d), _texts(s, d), _index(s, d), adapters.vectors(s, d)), "scores", compression="zstd")


def _norm(s: SparkSession, d: str) -> DataFrame:
    return metrics.minmax(metrics.minmax(_both(s, d), "bm25_score", "bm25_norm"), "semantic_score", "semantic_norm")


def _who(df: DataFrame) -> DataFrame:
    return df.withColumn("who", F.concat_ws("|", "dataset", "user_id"))


# Adapters, parsing, split, store -------------------------------------------------------------------------------------


@_query("impressions_adapter", query("imp", "SELECT impression_id, dataset, user_id, article_id, us, clicked, position, read_time FROM imp"))
def impressions_adapter(s: SparkSession, d: str) -> DataFrame:
    return adapters.impressions(s, d).drop("session_id")


@_query("history_adapter", query("hist", "SELECT * FROM hist"))
def history_adapter(s: SparkSession, d: str) -> DataFrame:
    return adapters.history(s, d)


def _behaviors(s: SparkSession, d: str) -> DataFrame:
    token = F.concat("article_id", F.lit("-"), F.col("clicked").cast("string"))
    # Every seventh article has a token without its label, which parsing drops.
    token = F.when(F.col("article_id").cast("long") % 7 == 0, F.col("article_id")).otherwise(token)
    listed = F.array_sort(F.collect_list(F.struct("position", token.alias("t"))))
    return adapters.impressions(s, d).groupBy("impression_id", "user_id").agg(F.concat_ws(" ", F.transform(listed, lambda x: x["t"])).alias("impressions"))


@_query("explode_candidates", query("imp", "SELECT impression_id, user_id, position, article_id, clicked FROM imp WHERE CAST(article_id AS BIGINT) % 7 <> 0"))
def explode_candidates(s: SparkSession, d: str) -> DataFrame:
    return tab_layout.candidates(_behaviors(s, d))


@_query("malformed_tokens", query("imp", "SELECT count(*) AS malformed FROM imp WHERE CAST(article_id AS BIGINT) % 7 = 0"))
def malformed_tokens(s: SparkSession, d: str) -> DataFrame:
    return tab_layout.malformed(_behaviors(s, d))


@_query("inview_clicked", query("imp", """
SELECT 'odd:' || impression_id AS impression_id, user_id, article_id, us, max(clicked) OVER (PARTITION BY impression_id, article_id) AS clicked, position
FROM imp WHERE dataset = 'odd'"""))
def inview_clicked(s: SparkSession, d: str) -> DataFrame:
    at = F.array_sort(F.collect_list(F.struct("position", "article_id")))
    clicked = F.collect_set(F.when(F.col("clicked") == 1, F.col("article_id")))
    raw = adapters.impressions(s, d).where("dataset = 'odd'").groupBy("impression_id", "user_id").agg(
        F.transform(at, lambda x: x["article_id"]).alias("article_ids_inview"),
        F.when(F.size(clicked) > 0, clicked).alias("article_ids_clicked"),
        F.timestamp_micros(F.min("us")).alias("t"), F.min("session_id").alias("session_id"), F.min("read_time").alias("read_time"),
    ).withColumn("impression_time", F.col("t").cast("timestamp_ntz"))
    return array_layout.impressions(raw, dataset="odd").select("impression_id", "user_id", "article_id", "us", "clicked", "position")


@_query("history_zip", query("num", "SELECT user_id, article_id, us, CAST(k - 1 AS INTEGER) AS hist_pos FROM num WHERE dataset = 'odd'"))
def history_zip(s: SparkSession, d: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("us", "source_row", "hist_pos", "article_id")))
    raw = adapters.history(s, d).where("dataset = 'odd'").groupBy("user_id").agg(listed.alias("r")).select(
        "user_id", F.transform("r", lambda x: x["article_id"]).alias("article_id_fixed"),
        # One time too many: the longer array is cut.
        F.concat(F.transform("r", lambda x: F.timestamp_micros(x["us"]).cast("timestamp_ntz")), F.array(F.expr("TIMESTAMP_NTZ'2030-01-01'"))).alias("impression_time_fixed"),
    )
    return array_layout.history(raw, dataset="odd").select("user_id", "article_id", "us", "hist_pos")


@_query("dedup_articles", """
SELECT CAST(l_partkey AS VARCHAR) AS article_id, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS rk FROM lineitem) WHERE rk = 1""")
def dedup_articles(s: SparkSession, d: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]
    first = store.first_by_key(adapters.table(s, d, "lineitem"), ["l_partkey"], order)
    return first.select(F.col("l_partkey").cast("string").alias("article_id"), "l_suppkey", "l_orderkey")


@_query("temporal_split", query("spl", "SELECT impression_id, article_id, position, dataset, split FROM spl"))
def temporal_split(s: SparkSession, d: str) -> DataFrame:
    return _split(s, d).select("impression_id", "article_id", "position", "dataset", "split")


@_query("split_counts", query("spl", """
SELECT dataset, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test
FROM spl GROUP BY dataset"""))
def split_counts(s: SparkSession, d: str) -> DataFrame:
    return split.split_counts(_split(s, d))


@_query("article_features", query("art", """
SELECT article_id, dataset, trim(title || ' ' || abstract || ' ') AS text, title, abstract, category, subcategory, entities FROM art"""))
def article_features(s: SparkSession, d: str) -> DataFrame:
    return store.article_features(adapters.articles(s, d)).drop("embedding")


@_query("user_features", query("usr", """
SELECT user_id, dataset, string_agg(article_id, ',' ORDER BY k) AS click_history, count(*) AS n_clicks, max(us) AS last_click_us,
       CAST(floor((max(cutoff) - max(us)) / 86400000000.0) AS INTEGER) AS recency_days FROM usr GROUP BY ALL"""))
def user_features(s: SparkSession, d: str) -> DataFrame:
    return _users(s, d).withColumn("click_history", F.concat_ws(",", "click_history"))


@_query("clicks_distribution", query("usr", f"""
SELECT dataset, count(*) AS users, min(n) AS least, max(n) AS most, {r6('avg(n)')} AS mean, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50,
       quantile_cont(n, 0.75) AS p75, quantile_cont(n, 0.9) AS p90 FROM (SELECT dataset, user_id, count(*) AS n FROM usr GROUP BY ALL) GROUP BY dataset"""))
def clicks_distribution(s: SparkSession, d: str) -> DataFrame:
    return _rounded(store.clicks_distribution(_users(s, d)), "mean")


# Point-in-time features ----------------------------------------------------------------------------------------------


@_query("click_history", query("clk rec", f"""
SELECT c.impression_id, dataset, user_id, n_clicks_before, {r6('(us - last_us) / 86400000000.0')} AS days_since_last_click,
       n_clicks_before <= 5 AS is_cold_start, coalesce(ids, '') AS recent_article_ids
FROM clk c LEFT JOIN (SELECT impression_id, string_agg(article_id, ',' ORDER BY k) AS ids FROM rec GROUP BY ALL) r USING (impression_id)"""))
def click_history(s: SparkSession, d: str) -> DataFrame:
    out = _clicks(s, d).withColumn("recent_article_ids", F.concat_ws(",", "recent_article_ids"))
    return _rounded(out.drop("us", "recency_weighted_click_count"), "days_since_last_click")


@_query("recency_decay", query("clk", f"SELECT impression_id, {r6('decayed')} AS recency_weighted_click_count FROM clk"))
def recency_decay(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_clicks(s, d).select("impression_id", "recency_weighted_click_count"), "recency_weighted_click_count")


@_query("recent_attributes", query("recat", """
SELECT impression_id, string_agg(title, '|' ORDER BY k) AS recent_titles, string_agg(category, '|' ORDER BY k) AS recent_categories FROM recat GROUP BY ALL"""))
def recent_attributes(s: SparkSession, d: str) -> DataFrame:
    known = bh.with_attributes(_hist(s, d), adapters.articles(s, d), "title", "category")
    out = bh.click_history(_imp(s, d), known, attributes=("title", "category")).where(F.size("recent_titles") > 0)
    return out.select("impression_id", *(F.concat_ws("|", c).alias(c) for c in ("recent_titles", "recent_categories")))


@_query("history_vectors", query("rec clk slot", f"""
SELECT impression_id, d AS dim, {r6('x / sqrt(sum(x * x) OVER (PARTITION BY impression_id)) + 2')} AS x FROM (SELECT impression_id, d, avg(x) AS x FROM rec JOIN slot USING (article_id) GROUP BY ALL)
"""))
def history_vectors(s: SparkSession, d: str) -> DataFrame:
    known = _hist(s, d).join(adapters.vectors(s, d), "article_id", "left")
    pooled = bh.in_sequence(bh.distinct_impressions(_imp(s, d)), known, ("vec",), config.N_RECENT_CLICKS).where("_click = 0")
    pooled = pooled.select("impression_id", bh.pooled(F.col("_recent.vec")).alias("history_vec"))
    return pooled.select("impression_id", F.posexplode("history_vec").alias("at", "x")).select(
        "impression_id", (F.col("at") + 1).cast("long").alias("dim"), _r6(F.col("x") + 2).alias("x")
    )


@_query("article_dynamic", query("fresh", f"""
SELECT impression_id, article_id, position, CAST(cum_clicks_prior AS BIGINT) AS cum_clicks_prior, cum_impressions_prior, {r6('ctr')} AS popularity_prior_ctr FROM fresh"""))
def article_dynamic(s: SparkSession, d: str) -> DataFrame:
    out = bh.article_popularity(_split(s, d)).select("impression_id", "article_id", "position", "cum_clicks_prior", "cum_impressions_prior", "popularity_prior_ctr")
    return _rounded(out, "popularity_prior_ctr")


@_query("article_dynamic_timeless", query("imp", f"""
SELECT impression_id, article_id, position, CASE WHEN us IS NOT NULL THEN CAST(coalesce(sum(clicked) OVER w, 0) AS BIGINT) END AS cum_clicks_prior,
       CASE WHEN us IS NOT NULL THEN count(*) OVER w END AS cum_impressions_prior FROM (SELECT * REPLACE (CASE WHEN CAST(impression_id AS BIGINT) % 5 > 0 THEN us END AS us) FROM imp)
WINDOW w AS (PARTITION BY dataset, article_id, us IS NULL ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def article_dynamic_timeless(s: SparkSession, d: str) -> DataFrame:
    """Popularity where a fifth of the impressions has no time: these stay, without counts."""
    shown = _imp(s, d).withColumn("us", F.when(F.col("impression_id").cast("long") % 5 > 0, F.col("us")))
    return bh.article_popularity(shown).select("impression_id", "article_id", "position", "cum_clicks_prior", "cum_impressions_prior")


@_query("freshness", query("fresh", f"SELECT impression_id, article_id, position, category, {r6('freshness_hours')} AS freshness_hours FROM fresh"))
def freshness(s: SparkSession, d: str) -> DataFrame:
    out = bh.freshness(_split(s, d), adapters.articles(s, d)).select("impression_id", "article_id", "position", "category", "freshness_hours")
    return _rounded(out, "freshness_hours")


@_query("sessions", query("ses", "SELECT impression_id, session_key FROM ses"))
def sessions(s: SparkSession, d: str) -> DataFrame:
    return bh.sessions(_imp(s, d), gap_minutes=GAP_MINUTES).select("impression_id", "session_key")


@_query("session_counts", query("ses", "SELECT impression_id, clicks_before AS session_click_count_before, impressions_before AS session_impressions_before FROM ses"))
def session_counts(s: SparkSession, d: str) -> DataFrame:
    return bh.sessions(_imp(s, d), gap_minutes=GAP_MINUTES).select("impression_id", "session_click_count_before", "session_impressions_before")


@_query("dwell_prior", query("ses", "SELECT impression_id, round(dwell + 1.3e-7, 3) AS avg_dwell_time_before FROM ses"))
def dwell_prior(s: SparkSession, d: str) -> DataFrame:
    return bh.sessions(_imp(s, d)).select("impression_id", F.round(F.col("avg_dwell_time_before") + F.lit(1.3e-7), 3).alias("avg_dwell_time_before"))


@_query("category_match", query("catm", f"SELECT impression_id, article_id, position, category_match, {r6('category_match_frac')} AS category_match_frac FROM catm"))
def category_match(s: SparkSession, d: str) -> DataFrame:
    clicks = _clicks_with_categories(s, d)
    out = bh.category_match(bh.freshness(_imp(s, d), adapters.articles(s, d)), clicks)
    return _rounded(out.select("impression_id", "article_id", "position", "category_match", "category_match_frac"), "category_match_frac")


@_query("position_prior", query("pri", f"SELECT dataset, position, {r6('prior')} AS position_ctr_prior FROM pri"))
def position_prior(s: SparkSession, d: str) -> DataFrame:
    return _rounded(bh.position_prior(_split(s, d)), "position_ctr_prior")


def _behavioral(s: SparkSession, d: str) -> DataFrame:
    return bh.behavioral(_split(s, d), _hist(s, d), adapters.articles(s, d), gap_minutes=GAP_MINUTES)


@_query("behavioral", query("catm clk ses pri", f"""
SELECT m.impression_id, m.article_id, m.position, m.split, CAST(cum_clicks_prior AS BIGINT) AS cum_clicks_prior, cum_impressions_prior, {r6('ctr')} AS popularity_prior_ctr, m.category,
       {r6('freshness_hours')} AS freshness_hours, category_match, {r6('category_match_frac')} AS category_match_frac, n_clicks_before,
       {r6('decayed')} AS recency_weighted_click_count, n_clicks_before <= 5 AS is_cold_start, clicks_before AS session_click_count_before,
       impressions_before AS session_impressions_before, {r6('prior')} AS position_ctr_prior
FROM catm m JOIN clk USING (impression_id) JOIN ses USING (impression_id) LEFT JOIN pri ON m.dataset = pri.dataset AND m.position = pri.position"""))
def behavioral(s: SparkSession, d: str) -> DataFrame:
    out = _behavioral(s, d).select(
        "impression_id", "article_id", "position", "split", "cum_clicks_prior", "cum_impressions_prior", "popularity_prior_ctr", "category", "freshness_hours",
        "category_match", "category_match_frac", "n_clicks_before", "recency_weighted_click_count", "is_cold_start", "session_click_count_before",
        "session_impressions_before", "position_ctr_prior",
    )
    return _rounded(out, "popularity_prior_ctr", "freshness_hours", "category_match_frac", "recency_weighted_click_count", "position_ctr_prior")


@_query("no_leakage", query("catm clk ses", """
SELECT count(*) FILTER (n_clicks_before < 0) AS negative_clicks, count(*) FILTER (c.us - last_us <= 0) AS negative_days,
       count(*) FILTER (cum_clicks_prior > cum_impressions_prior) AS clicks_over_impressions, count(*) FILTER (freshness_hours < 0) AS negative_freshness,
       count(*) FILTER (clicks_before > impressions_before) AS session_clicks_over_impressions
FROM catm m JOIN clk c USING (impression_id) JOIN ses s USING (impression_id)"""))
def no_leakage(s: SparkSession, d: str) -> DataFrame:
    return bh.leakage(_behavioral(s, d))


@_query("feature_means", query("catm clk ses", f"""
SELECT m.dataset, {r6('avg(n_clicks_before)')} AS n_clicks_before, {r6('avg(ctr)')} AS popularity_prior_ctr, round(avg(freshness_hours) + 1.3e-7, 3) AS freshness_hours,
       {r6('avg(category_match_frac)')} AS category_match_frac, {r6('avg(impressions_before)')} AS session_impressions_before, {r6('avg(CAST(n_clicks_before <= 5 AS DOUBLE))')} AS cold_start_share
FROM catm m JOIN clk USING (impression_id) JOIN ses USING (impression_id) GROUP BY m.dataset"""))
def feature_means(s: SparkSession, d: str) -> DataFrame:
    out = bh.feature_means(_behavioral(s, d)).withColumn("freshness_hours", F.round(F.col("freshness_hours") + F.lit(1.3e-7), 3))
    return _rounded(out, "n_clicks_before", "popularity_prior_ctr", "category_match_frac", "session_impressions_before", "cold_start_share")


# Metrics -------------------------------------------------------------------------------------------------------------


def _one_metric(metric: str, s: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate_scores(_popular(s, d), "score").select("impression_id", _r6(metric).alias(metric))


for _m in ("auc", "mrr", "ndcg5", "ndcg10"):
    _query(_m, query("jud", f"SELECT impression_id, {r6(_m)} AS {_m} FROM jud"))(partial(_one_metric, _m))

_MEANS = ", ".join(f"{r6(f'avg({m})')} AS {m}" for m in ("auc", "mrr", "ndcg5", "ndcg10"))


@_query("evaluate_scores", query("jud spl", f"""
SELECT split, count(*) AS n, {_MEANS} FROM jud JOIN (SELECT impression_id, min(split) AS split FROM spl GROUP BY ALL) USING (impression_id) GROUP BY split"""))
def evaluate_scores(s: SparkSession, d: str) -> DataFrame:
    """The flagship: popularity before the instant, judged per impression, averaged by split."""
    judged_ = metrics.evaluate_scores(_popular(s, d), "score", keys=("split", "impression_id"))
    names = ("auc", "mrr", "ndcg5", "ndcg10")
    return _rounded(judged_.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in names)), *names)


def _lists(s: SparkSession, d: str) -> DataFrame:
    return metrics.cap_top_k(_popular(s, d).where("split = 'test'"), "score", config.RECLIST_K).select("impression_id", "article_id")


@_query("diversity", query("list vec", f"""
SELECT i.impression_id, CASE WHEN n >= 2 THEN {r6('1 - s / (n * (n - 1) / 2.0)')} END AS diversity FROM (SELECT DISTINCT impression_id FROM list) i LEFT JOIN (
  SELECT impression_id, sum(CASE WHEN r1 < r2 THEN list_dot_product(a, b) ELSE 0 END) AS s, count(DISTINCT r1) AS n FROM (
    SELECT x.impression_id, x.r AS r1, y.r AS r2, x.v AS a, y.v AS b FROM
      (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY article_id) AS r FROM list JOIN vec USING (article_id)) x JOIN
      (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY article_id) AS r FROM list JOIN vec USING (article_id)) y USING (impression_id))
  GROUP BY ALL) p USING (impression_id)"""))
def diversity(s: SparkSession, d: str) -> DataFrame:
    return _rounded(beyond.diversity(_lists(s, d), adapters.vectors(s, d)), "diversity")


@_query("novelty", query("list tpop", f"""
SELECT impression_id, {r6('avg(-log2((coalesce(clicks, 0) + 1.0) / (t.total + t.known + 1)))')} AS novelty FROM list LEFT JOIN tpop USING (article_id)
CROSS JOIN (SELECT sum(clicks) AS total, count(*) AS known FROM tpop) t GROUP BY impression_id"""))
def novelty(s: SparkSession, d: str) -> DataFrame:
    return _rounded(beyond.novelty(_lists(s, d), beyond.train_popularity(_split(s, d))), "novelty")


@_query("coverage", query("list", f"""
SELECT seen, size, {r6('seen / CAST(size AS DOUBLE)')} AS coverage FROM (SELECT count(DISTINCT article_id) AS seen FROM list) CROSS JOIN (SELECT count(DISTINCT p_partkey) AS size FROM part)"""))
def coverage(s: SparkSession, d: str) -> DataFrame:
    return _rounded(beyond.coverage(_lists(s, d), adapters.articles(s, d)), "coverage")


# Lexical retrieval ---------------------------------------------------------------------------------------------------


@_query("tokenize_counts", query("dpstt", "SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM dpstt GROUP BY term"))
def tokenize_counts(s: SparkSession, d: str) -> DataFrame:
    return adapters.corpus(s, d).select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@_query("bm25_postings", query("dpst", f"SELECT article_id, term, tf, df, {r6('weight')} AS weight FROM dpst"))
def bm25_postings(s: SparkSession, d: str) -> DataFrame:
    return _rounded(bm25.postings(adapters.corpus(s, d)), "weight")


@_query("bm25_topk", query("dpst dpstt", f"""
SELECT query_id, article_id, rk AS rank, {r6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, article_id) AS rk FROM (
  SELECT q.article_id AS query_id, p.article_id, sum(weight) AS score FROM dpstt q JOIN dpst p USING (term) WHERE CAST(q.article_id AS BIGINT) % 50 = 0 GROUP BY ALL)) WHERE rk <= 20"""))
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    docs = adapters.corpus(s, d)
    # Every document whose id is divisible by 50 is a query; the whole corpus is searched.
    asked = docs.where(F.col("article_id").cast("long") % 50 == 0).withColumnRenamed("article_id", "query_id")
    found = bm25.top_k(bm25.query_terms(asked), written(bm25.postings(docs), "postings"), 20)
    return _rounded(found.select("query_id", "article_id", F.col("rank").cast("long").alias("rank"), "score"), "score")


@_query("bm25_score_pairs", query("lex", f"SELECT impression_id, article_id, position, {r6('bm25_score')} AS bm25_score FROM lex"))
def bm25_score_pairs(s: SparkSession, d: str) -> DataFrame:
    out = rerank.add_retrieval_scores(_imp(s, d), _hist(s, d), _texts(s, d), _index(s, d), None)
    return _rounded(out.select("impression_id", "article_id", "position", "bm25_score"), "bm25_score")


def _truth(s: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    shown = _who(_split(s, d)).where("split <> 'train' and clicked = 1").select("who", "impression_id", "article_id").distinct()
    return shown.join(asked.select("who").distinct().withColumn("known", F.lit(True)), "who", "left").withColumn("asked", F.coalesce("known", F.lit(False))).drop("known")


def _judgeable(queries: DataFrame, s: SparkSession, d: str) -> DataFrame:
    """Queries of users who have a click to be found; nobody else's answer is looked at."""
    return queries.join(_who(_split(s, d)).where("split <> 'train' and clicked = 1").select("who").distinct(), "who", "left_semi")


def _hits(found: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    retrieved = truth.where("asked").select("impression_id", "who", "article_id").join(found, ["who", "article_id"])
    return metrics.hit_rates(retrieved.select("impression_id", "article_id", "rank"), truth, config.RECALL_KS, by=by)


def _hit_sql(top: str, asked: str) -> str:
    rates = ", ".join(f"{r6(f'avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END)')} AS hit_rate_{k}" for k in config.RECALL_KS)
    return f"""SELECT count(*) AS n, {rates} FROM (SELECT t.impression_id, min(rk) AS first FROM truth t LEFT JOIN {top} u ON t.who = u.who AND t.article_id = u.article_id
WHERE t.who IN (SELECT who FROM {asked}) GROUP BY ALL)"""


@_query("bm25_hit_rate", query("truth utop uqry", _hit_sql("utop", "uqry")))
def bm25_hit_rate(s: SparkSession, d: str) -> DataFrame:
    terms = written(_judgeable(bm25.history_queries(_who(_users(s, d)), _texts(s, d), id_col="who", n_recent=5), s, d), "terms")
    out = _hits(bm25.top_k(terms, written(bm25.folded(_index(s, d), 200), "folded"), 200, query_col="who"), _truth(s, d, terms))
    return _rounded(out, *(f"hit_rate_{k}" for k in config.RECALL_KS))


@_query("zero_overlap", query("truth uqry pstt", f"""
SELECT count(*) AS n, {r6('avg(CASE WHEN met IS NULL THEN 1.0 ELSE 0.0 END)')} AS share FROM (SELECT impression_id, who, min(CAST(article_id AS BIGINT)) AS aid FROM truth
  WHERE who IN (SELECT who FROM uqry) GROUP BY ALL) t LEFT JOIN (SELECT DISTINCT who, CAST(article_id AS BIGINT) AS aid, 1 AS met FROM uqry JOIN pstt USING (term)) o USING (who, aid)"""))
def zero_overlap(s: SparkSession, d: str) -> DataFrame:
    terms = bm25.history_queries(_who(_users(s, d)), _texts(s, d), id_col="who", n_recent=5)
    asked = terms.groupBy("who").agg(F.collect_set("term").alias("query"))
    first = _truth(s, d, terms).where("asked").groupBy("impression_id", "who").agg(F.min(F.col("article_id").cast("long")).cast("string").alias("article_id"))
    joined = first.join(asked, "who").join(_texts(s, d), "article_id", "left")
    none = ~F.arrays_overlap("query", tokens(F.col("text")))
    return joined.agg(F.count(F.lit(1)).alias("n"), _r6(F.avg(none.cast("double"))).alias("share"))


# Dense retrieval, fusion ---------------------------------------------------------------------------------------------


@_query("user_vector", query("uvec", f"SELECT who, CAST(d AS BIGINT) AS dim, {r6('x + 2')} AS x FROM uvec"))
def user_vector(s: SparkSession, d: str) -> DataFrame:
    pooled = _who(dense.user_vectors(_users(s, d), adapters.vectors(s, d), n_recent=5))
    return pooled.select("who", F.posexplode("history_vec").alias("at", "x")).select("who", (F.col("at") + 1).cast("long").alias("dim"), _r6(F.col("x") + 2).alias("x"))


def _pooled(s: SparkSession, d: str) -> DataFrame:
    return written(_who(dense.user_vectors(_users(s, d), adapters.vectors(s, d), n_recent=5)).select("who", "history_vec"), "pooled")


@_query("dense_topk", query("vtop", f"SELECT who, article_id, rk AS rank, {r6('score + 2')} AS score FROM vtop WHERE rk <= 50"))
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    found = dense.top_k(_pooled(s, d), adapters.vectors(s, d), 50, query_col="who")
    return found.select("who", "article_id", F.col("rank").cast("long").alias("rank"), _r6(F.col("score") + 2).alias("score"))


@_query("dense_score_pairs", query("lexsem", f"SELECT impression_id, article_id, position, {r6('semantic_score + 2')} AS semantic_score FROM lexsem"))
def dense_score_pairs(s: SparkSession, d: str) -> DataFrame:
    out = rerank.add_retrieval_scores(_imp(s, d), _hist(s, d), None, None, adapters.vectors(s, d))
    return out.select("impression_id", "article_id", "position", _r6(F.col("semantic_score") + 2).alias("semantic_score"))


@_query("dense_hit_rate", query("truth vtop uvec", _hit_sql("vtop", "uvec")))
def dense_hit_rate(s: SparkSession, d: str) -> DataFrame:
    pooled = _pooled(s, d)
    found = dense.top_k(_judgeable(pooled, s, d), adapters.vectors(s, d), 200, query_col="who")
    return _rounded(_hits(found, _truth(s, d, pooled)), *(f"hit_rate_{k}" for k in config.RECALL_KS))


@_query("retrieval_compare", query("truth utop uqry vtop uvec", f"SELECT 'lexical' AS method, * FROM ({_hit_sql('utop', 'uqry')}) UNION ALL SELECT 'semantic', * FROM ({_hit_sql('vtop', 'uvec')})"))
def retrieval_compare(s: SparkSession, d: str) -> DataFrame:
    both = bm25_hit_rate(s, d).withColumn("method", F.lit("lexical")).unionByName(dense_hit_rate(s, d).withColumn("method", F.lit("semantic")))
    return both.select("method", "n", *(f"hit_rate_{k}" for k in config.RECALL_KS))


def _cold(users: DataFrame) -> DataFrame:
    """Users with no more train clicks than the lower quartile of their dataset."""
    quartile = few(users.groupBy("dataset").agg(F.percentile("n_clicks", 0.25).alias("p25")))
    return users.join(quartile, "dataset").select("who", F.when(F.col("n_clicks") <= F.col("p25"), "cold").otherwise("warm").alias("slice"))


def _slice_sql(method: str, top: str, asked: str) -> str:
    rates = ", ".join(f"{r6(f'avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END)')} AS hit_rate_{k}" for k in config.RECALL_KS)
    return f"""SELECT slice, '{method}' AS method, count(*) AS n, {rates} FROM (
SELECT t.impression_id, slice, min(rk) AS first FROM truth t JOIN cold USING (who) LEFT JOIN {top} u ON t.who = u.who AND t.article_id = u.article_id
WHERE t.who IN (SELECT who FROM {asked}) GROUP BY ALL) GROUP BY slice"""


@_query("retrieval_slices", query("truth utop uqry vtop uvec cold", f"{_slice_sql('lexical', 'utop', 'uqry')} UNION ALL {_slice_sql('semantic', 'vtop', 'uvec')}"))
def retrieval_slices(s: SparkSession, d: str) -> DataFrame:
    """Hit rates of both retrievers for users below and above the lower quartile of train clicks."""
    users, pooled = written(_who(_users(s, d)), "users"), _pooled(s, d)
    terms = written(_judgeable(bm25.history_queries(users, _texts(s, d), id_col="who", n_recent=5), s, d), "terms")
    found = {
        "lexical": (terms, bm25.top_k(terms, written(bm25.folded(_index(s, d), 200), "folded"), 200, query_col="who")),
        "semantic": (pooled, dense.top_k(_judgeable(pooled, s, d), adapters.vectors(s, d), 200, query_col="who")),
    }
    parts = [
        _hits(near, _truth(s, d, asked).join(_cold(users), "who"), ("slice",)).withColumn("method", F.lit(method)) for method, (asked, near) in found.items()
    ]
    return _rounded(parts[0].unionByName(parts[1]), *(f"hit_rate_{k}" for k in config.RECALL_KS))


@_query("hashed_embeddings")
def hashed_embeddings(s: SparkSession, d: str) -> DataFrame:
    return dense.hashed_embeddings(adapters.corpus(s, d))


@_query("minmax", query("norm", f"SELECT impression_id, article_id, position, {r6('bm25_norm')} AS bm25_norm, {r6('semantic_norm')} AS semantic_norm FROM norm"))
def minmax(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_norm(s, d).select("impression_id", "article_id", "position", "bm25_norm", "semantic_norm"), "bm25_norm", "semantic_norm")


@_query("hybrid", query("norm", f"SELECT impression_id, article_id, position, {r6('0.3 * bm25_norm + 0.7 * semantic_norm')} AS hybrid FROM norm"))
def hybrid(s: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.hybrid(_norm(s, d), 0.3).select("impression_id", "article_id", "position", "hybrid"), "hybrid")


_SWEEP = "(SELECT *, round(alpha * bm25_norm + (1.0 - alpha) * semantic_norm, 9) AS hybrid FROM norm CROSS JOIN (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS alpha) WHERE split = 'val')"


@_query("alpha_sweep", query("norm", f"SELECT alpha, count(*) AS n, {_MEANS} FROM ({judged(_SWEEP, 'hybrid', 'alpha, impression_id')}) GROUP BY alpha"))
def alpha_sweep(s: SparkSession, d: str) -> DataFrame:
    # Nine digits, so that scores that are equal on paper tie on both sides.
    mixed = _norm(s, d).where("split = 'val'").withColumn("alpha", F.explode(F.array(*map(F.lit, config.ALPHAS))))
    mixed = mixed.withColumn("hybrid", F.round(F.col("alpha") * F.col("bm25_norm") + (1 - F.col("alpha")) * F.col("semantic_norm"), 9))
    names = ("auc", "mrr", "ndcg5", "ndcg10")
    judged_ = metrics.evaluate_scores(mixed, "hybrid", keys=("alpha", "impression_id"))
    return _rounded(judged_.groupBy("alpha").agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in names)), *names)


@_query("best_alpha")
def best_alpha(s: SparkSession, d: str) -> DataFrame:
    return metrics.alpha_sweep(_norm(s, d).where("split = 'val'"), config.ALPHAS)


@_query("cap_top_k", query("scored", "SELECT impression_id, article_id, position FROM (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, position, article_id) AS rk FROM scored) WHERE rk <= 3"))
def cap_top_k(s: SparkSession, d: str) -> DataFrame:
    return metrics.cap_top_k(_popular(s, d), "score", 3).select("impression_id", "article_id", "position")


# Slices and evaluators -----------------------------------------------------------------------------------------------

_SLICED = "UNION ALL ".join(
    f"SELECT slice, '{m}' AS metric, count({m}) AS n, {r6(f'avg({m})')} AS mean FROM s GROUP BY slice " for m in ("auc", "mrr", "ndcg5", "ndcg10")
)


@_query("cold_warm", query("jud clk", f"SELECT * FROM (WITH s AS (SELECT jud.*, CASE WHEN n_clicks_before <= 5 THEN 'cold' ELSE 'warm' END AS slice FROM jud JOIN clk USING (impression_id)) {_SLICED})"))
def cold_warm(s: SparkSession, d: str) -> DataFrame:
    judged_ = metrics.evaluate_scores(_popular(s, d), "score").join(_clicks(s, d).select("impression_id", "is_cold_start"), "impression_id")
    return _rounded(metrics.by_slice(judged_, {"cold": F.col("is_cold_start"), "warm": ~F.col("is_cold_start")}), "mean")


@_query("head_tail", query("jud scored spl", f"""
SELECT * FROM (WITH s AS (SELECT jud.*, CASE WHEN head THEN 'head' ELSE 'tail' END AS slice FROM jud JOIN (
  SELECT impression_id, bool_or(coalesce(clicks >= (SELECT quantile_cont(clicks, 0.8) FROM (SELECT article_id, sum(clicked) AS clicks FROM spl WHERE split = 'train' GROUP BY ALL)), false)) AS head
  FROM (SELECT * FROM scored WHERE clicked = 1) c LEFT JOIN (SELECT article_id, sum(clicked) AS clicks FROM spl WHERE split = 'train' GROUP BY ALL) USING (article_id) GROUP BY ALL) USING (impression_id)) {_SLICED})"""))
def head_tail(s: SparkSession, d: str) -> DataFrame:
    scored = _popular(s, d)
    heads = beyond.head_articles(beyond.train_popularity(_split(s, d), clicked_only=False), config.HEAD_PERCENTILE)
    of = scored.where("clicked = 1").join(heads, "article_id", "left").groupBy("impression_id").agg(F.max(F.coalesce("head", F.lit(False))).alias("head"))
    judged_ = metrics.evaluate_scores(scored, "score").join(of, "impression_id")
    return _rounded(metrics.by_slice(judged_, {"head": F.col("head"), "tail": ~F.col("head")}), "mean")


@_query("eval_harness", query("lexsem", f"""
SELECT method, count(*) AS n, {_MEANS} FROM (SELECT 'bm25' AS method, auc, mrr, ndcg5, ndcg10 FROM ({judged("(SELECT *, round(bm25_score, 9) AS sc FROM lexsem WHERE split = 'test')", 'sc')})
UNION ALL SELECT 'semantic', auc, mrr, ndcg5, ndcg10 FROM ({judged("(SELECT *, round(semantic_score, 9) AS sc FROM lexsem WHERE split = 'test')", 'sc')})) GROUP BY method"""))
def eval_harness(s: SparkSession, d: str) -> DataFrame:
    scored = _both(s, d).where("split = 'test'")
    names = ("auc", "mrr", "ndcg5", "ndcg10")
    parts = [
        metrics.evaluate_scores(scored.withColumn("sc", F.round(f"{m}_score", 9)), "sc").withColumn("method", F.lit(m)) for m in ("bm25", "semantic")
    ]
    return _rounded(parts[0].unionByName(parts[1]).groupBy("method").agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in names)), *names)


@_query("submission_ranks", query("scored", """
SELECT impression_id, impression_id || ' [' || string_agg(CAST(rk AS VARCHAR), ',' ORDER BY position) || ']' AS line
FROM (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, position) AS rk FROM scored) GROUP BY impression_id"""))
def submission_ranks(s: SparkSession, d: str) -> DataFrame:
    return submit.submission_lines(_popular(s, d), "score")


@_query("hybrid_submission", query("norm", """
SELECT impression_id, impression_id || ' [' || string_agg(CAST(rk AS VARCHAR), ',' ORDER BY position) || ']' AS line
FROM (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY round(0.3 * bm25_norm + 0.7 * semantic_norm, 9) DESC, position) AS rk FROM norm WHERE split = 'test')
GROUP BY impression_id"""))
def hybrid_submission(s: SparkSession, d: str) -> DataFrame:
    """The test impressions, without their labels, as a ranked submission."""
    asked = _split(s, d).where("split = 'test'").drop("clicked", "split")
    return runs.hybrid_submission(asked, _hist(s, d), _texts(s, d), _index(s, d), adapters.vectors(s, d), alpha=0.3)


@_query("full_evaluation")
def full_evaluation(s: SparkSession, d: str) -> DataFrame:
    """Accuracy, diversity, novelty and coverage of both retrievers and their mix, by slice, with intervals."""
    scored = metrics.hybrid(_norm(s, d), 0.3)
    return runs.full_evaluation(
        scored, {"bm25": "bm25_score", "semantic": "semantic_score", "hybrid": "hybrid"}, _clicks(s, d), adapters.articles(s, d), adapters.vectors(s, d)
    )


@_query("popularity_position_prior", query("imp", f"""
SELECT 'article' AS kind, article_id AS key, {r6('avg(clicked)')} AS ctr, count(*) AS n FROM imp GROUP BY article_id
UNION ALL SELECT 'position', CAST(position AS VARCHAR), {r6('avg(clicked)')}, count(*) FROM imp GROUP BY position"""))
def popularity_position_prior(s: SparkSession, d: str) -> DataFrame:
    shown = _imp(s, d)
    a = submit.popularity_prior(shown).select(F.lit("article").alias("kind"), F.col("article_id").alias("key"), "ctr", "n")
    return _rounded(a.union(submit.position_prior(shown).select(F.lit("position"), F.col("position").cast("string"), "ctr", "n")), "ctr")


def _values(s: SparkSession, d: str) -> DataFrame:
    judged_ = metrics.evaluate_scores(_popular(s, d), "score", keys=("split", "impression_id"))
    return judged_.select("split", F.col("impression_id").alias("row_id"), F.col("auc").alias("value")).where("split = 'test'")


@_query("bootstrap_ci")
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return bootstrap.bootstrap_ci(_values(s, d), keys=("split",))


@_query("poisson_bootstrap_ci")
def poisson_bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return bootstrap.poisson_ci(_values(s, d), keys=("split",))


@_query("paired_bootstrap")
def paired_bootstrap(s: SparkSession, d: str) -> DataFrame:
    scored = _both(s, d).where("split = 'test'")
    a, b = metrics.evaluate_scores(scored, "bm25_score"), metrics.evaluate_scores(scored, "semantic_score")
    return bootstrap.paired_significance(a, b, ("auc", "mrr"))


# Rankers and serving -------------------------------------------------------------------------------------------------


def _ranking_table(s: SparkSession, d: str) -> DataFrame:
    # The features are added to the scored candidates, so no table of candidates is joined with another.
    table = bh.behavioral(_both(s, d), _hist(s, d), adapters.articles(s, d), gap_minutes=GAP_MINUTES)
    return written(table.withColumn("row_id", F.concat_ws(":", "impression_id", "article_id", "position")), "ranking", compression="zstd")


def _ranker(table: DataFrame) -> rerank.Ranker:
    return rerank.train_ranker(table.where("split = 'train'"))


@_query("rerank_lambdamart")
def rerank_lambdamart(s: SparkSession, d: str) -> DataFrame:
    """Metrics before and after reranking by the operator's 200 trees, with intervals."""
    table = metrics.cap_top_k(_ranking_table(s, d), "semantic_score", config.STAGE1_K)
    scored = written(_ranker(table).score(table.where("split != 'train'")), "scored")
    return runs.before_and_after(scored, "semantic_score", "rank_score")


@_query("reranked_submission")
def reranked_submission(s: SparkSession, d: str) -> DataFrame:
    """The test impressions, without their labels, ranked by the ranker of rerank_lambdamart."""
    ranker = _ranker(metrics.cap_top_k(_ranking_table(s, d), "semantic_score", config.STAGE1_K))
    shown = _split(s, d)
    return runs.reranked_submission(
        shown.where("split = 'test'").drop("clicked", "split"), shown.where("split != 'test'"), _hist(s, d), adapters.articles(s, d),
        _texts(s, d), _index(s, d), adapters.vectors(s, d), ranker, gap_minutes=GAP_MINUTES,
    )


@_query("article_store", query("art imp", f"""
SELECT art.dataset, art.article_id, category, published_us, {r6('coalesce(ctr, 0.0)')} AS popularity_ctr FROM art LEFT JOIN (
  SELECT dataset, article_id, avg(clicked) AS ctr FROM imp GROUP BY ALL) USING (dataset, article_id)"""))
def article_store(s: SparkSession, d: str) -> DataFrame:
    return _rounded(serving.article_store(adapters.articles(s, d), _imp(s, d)), "popularity_ctr")


@_query("user_store", query("usr clk", f"""
SELECT u.user_id, u.dataset, click_history, n_clicks_before, {r6('decayed')} AS recency_weighted_click_count, n_clicks_before <= 5 AS is_cold_start
FROM (SELECT user_id, dataset, string_agg(article_id, ',' ORDER BY k) AS click_history FROM usr GROUP BY ALL) u LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY dataset, user_id ORDER BY n_clicks_before DESC, us DESC, impression_id DESC) AS rk FROM clk) c
ON u.user_id = c.user_id AND u.dataset = c.dataset AND rk = 1"""))
def user_store(s: SparkSession, d: str) -> DataFrame:
    clicks = _clicks_with_categories(s, d)
    out = serving.user_store(_users(s, d), clicks).withColumn("click_history", F.concat_ws(",", "click_history")).drop("recent_categories")
    return _rounded(out, "recency_weighted_click_count")


@_query("serve_batch")
def serve_batch(s: SparkSession, d: str) -> DataFrame:
    """Every user's reranked candidates; the ranker is the one of rerank_lambdamart."""
    shown, arts = _imp(s, d), adapters.articles(s, d)
    users = written(serving.user_store(_users(s, d), _clicks_with_categories(s, d)), "users")
    now = shown.agg(F.max("us")).first()[0]
    ranker = _ranker(metrics.cap_top_k(_ranking_table(s, d), "semantic_score", config.STAGE1_K))
    return serving.serve_batch(
        users, _texts(s, d), _index(s, d), adapters.vectors(s, d), serving.article_store(arts, shown), submit.position_prior(shown), ranker, now_us=now
    )


@_query("serving_capacity", f"""
SELECT count(*) AS n, {r6('avg(value)')} AS mean_ms, {r6('quantile_cont(value, 0.5)')} AS p50_ms, {r6('quantile_cont(value, 0.95)')} AS p95_ms, {r6('quantile_cont(value, 0.99)')} AS p99_ms,
       {r6('1000.0 / avg(value)')} AS qps, CAST(ceil(quantile_cont(value, 0.99) / 100.0) AS BIGINT) AS cores, {r6('avg(value) / 3600000.0 * 1000.0 * 0.05')} AS cost_per_1k FROM events WHERE event_type = 'view'""")
def serving_capacity(s: SparkSession, d: str) -> DataFrame:
    """The arithmetic over a column of durations (event values as milliseconds)."""
    out = serving.capacity(adapters.table(s, d, "events").where("event_type = 'view'").select(F.col("value").alias("ms")))
    return _rounded(out, "mean_ms", "p50_ms", "p95_ms", "p99_ms", "qps", "cost_per_1k")


@_query("index_bytes", query("pst vec", """
SELECT 'postings' AS part, count(*) AS rows, CAST(sum(strlen(term) + strlen(article_id) + 16) AS BIGINT) AS bytes FROM pst
UNION ALL SELECT 'vectors', count(*), CAST(sum(strlen(article_id) + 4 * len(v)) AS BIGINT) FROM vec""").replace("WITH ", f"SELECT *, {r6('bytes / 1048576.0')} AS mib FROM (WITH ", 1) + ")")
def index_bytes(s: SparkSession, d: str) -> DataFrame:
    return _rounded(serving.index_bytes(bm25.postings(_texts(s, d)), adapters.vectors(s, d)), "mib")


_VOCAB = "(SELECT term, CAST(row_number() OVER (ORDER BY sum(tf) DESC, term) + 1 AS INTEGER) AS id FROM dpstt GROUP BY term QUALIFY row_number() OVER (ORDER BY sum(tf) DESC, term) <= 19998)"


@_query("vocab", query("dpstt", f"SELECT * FROM {_VOCAB}"))
def vocab(s: SparkSession, d: str) -> DataFrame:
    return nrms.vocabulary(adapters.corpus(s, d), text_col="text")


@_query("encode_titles", query("dpstt dpstw", f"""
SELECT article_id, list_aggregate(list_concat(list_transform(coalesce(ids, []), lambda x: CAST(x AS VARCHAR)), list_transform(range(20 - len(coalesce(ids, []))), lambda x: '0')), 'string_agg', ',') AS ids
FROM (SELECT w.article_id, (SELECT list(coalesce(v.id, 1) ORDER BY spot) FROM (SELECT unnest(w.words[1:20]) AS term, generate_subscripts(w.words[1:20], 1) AS spot) t LEFT JOIN {_VOCAB} v USING (term)) AS ids FROM dpstw w)"""))
def encode_titles(s: SparkSession, d: str) -> DataFrame:
    coded = nrms.encode_titles(adapters.corpus(s, d), vocab(s, d), key="article_id", text_col="text")
    return coded.select("article_id", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))


@_query("negative_sample", query("imp", f"""
SELECT impression_id, article_id, position, clicked FROM (SELECT *, max(clicked) OVER (PARTITION BY impression_id) AS any_click,
  row_number() OVER (PARTITION BY impression_id, clicked ORDER BY md5(impression_id || ':' || CAST(position AS VARCHAR) || ':{config.SEED}'), position) AS spot FROM imp)
WHERE any_click = 1 AND (clicked = 1 OR spot <= 4)"""))
def negative_sample(s: SparkSession, d: str) -> DataFrame:
    return nrms.negative_sample(adapters.impressions(s, d)).select("impression_id", "article_id", "position", "clicked")


@_query("nrms_score")
def nrms_score(s: SparkSession, d: str) -> DataFrame:
    """Mean test metrics of the neural ranker after one short epoch."""
    shown, arts = _split(s, d), adapters.articles(s, d)
    words, cats = nrms.vocabulary(arts), nrms.category_vocabulary(arts)
    rows = written(nrms.examples(shown, _clicks(s, d), arts, words, cats, length=6, history=10), "examples")
    model, _ = nrms.train_model(
        nrms.negative_sample(rows.where("split = 'train'")), words=words.count() + 2, categories=cats.count() + 1, max_rows=2000, length=6, history=10, epochs=1, width=16, heads=2
    )
    scored = nrms.score_rows(rows.where("split = 'test'"), model, length=6, history=10)
    judged_ = metrics.evaluate_scores(scored, "nrms_score")
    return judged_.agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in ("auc", "mrr", "ndcg5", "ndcg10")))


@_query("nrms_comparison")
def nrms_comparison(s: SparkSession, d: str) -> DataFrame:
    """The neural ranker without and with categories and their paired difference; sizes as in nrms_score."""
    return runs.neural_comparison(
        _split(s, d), _clicks(s, d), adapters.articles(s, d), length=6, history=10, max_rows=2000, epochs=1, width=16, heads=2
    )


@_query("click_stream_sessions", """
SELECT user_id, session, count(*) AS events, CAST(sum(CAST(event_type = 'click' AS INTEGER)) AS BIGINT) AS clicks FROM (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 14400000000 THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY ALL""")
def click_stream_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of the event stream at a gap of four hours."""
    from rillrank.functions.columns import micros

    shown = adapters.table(s, d, "events").select(
        F.col("event_id").cast("string").alias("impression_id"), F.lit("stream").alias("dataset"), F.col("user_id").cast("string").alias("user_id"),
        micros(F.col("ts")).alias("us"), (F.col("event_type") == "click").cast("int").alias("clicked"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("double").alias("read_time"),
    )
    visits = bh.sessions(shown, gap_minutes=240.0).join(shown.select("impression_id", "clicked"), "impression_id")
    number = F.regexp_extract("session_key", "_dsid([0-9]+)$", 1).cast("long")
    return visits.groupBy(F.col("user_id").cast("long").alias("user_id"), number.alias("session")).agg(F.count(F.lit(1)).alias("events"), F.sum("clicked").alias("clicks"))
