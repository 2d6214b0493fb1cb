"""Point-in-time behavioural features: nothing that happens at or after an impression's instant is seen by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from rillrank.config import (
    COLD_START_MAX_CLICKS, DAY_US, HALF_LIFE_DAYS, HOUR_US, MINUTE_US, N_RECENT_CLICKS, SESSION_GAP_MINUTES,
)
from rillrank.functions.columns import few, held, normalised, ratio

#: Names of lists of article columns.
_PLURAL = {"title": "titles", "category": "categories"}

#: Buckets that candidates of articles are counted in, and the rows beyond which a bucket has a hot article.
_BUCKETS, HOT_ROWS = 1 << 16, 1 << 20

#: Half-lives of an epoch: weights relative to its start stay doubles, and what is two epochs old weighs below 2^-400.
_EPOCH = 400.0


def distinct_impressions(impressions: DataFrame, *extra: str) -> DataFrame:
    """One row per impression; all its candidates share these columns."""
    columns = ["dataset", "user_id", "us", *extra]
    return impressions.groupBy("impression_id").agg(*(F.min(c).alias(c) for c in columns))


def in_sequence(shown: DataFrame, history: DataFrame, carried: tuple[str, ...], n_recent: int, *, epoch_us: float | None = None) -> DataFrame:
    """Clicks and ``shown`` rows of each user in one order of time; ``_click`` is 1 for clicks, 0 for shown rows.

    ``_recent`` of a shown row lists the ``carried`` columns of the last ``n_recent`` clicks strictly before it (null
    before the first).  Shown rows precede clicks of the same instant, so what lies before a row in the order is what it
    may see: one shuffle, and no join of impressions with clicks.  Clicks without a time or user are seen by none.
    ``epoch_us`` is the length of the epochs that ``_epoch`` numbers.
    """
    clicks = history.where("us is not null and user_id is not null and dataset is not null").select(
        "dataset", "user_id", "us", "source_row", "hist_pos", F.struct(*carried).alias("_carried"), F.lit(1).alias("_click")
    )
    both = clicks.unionByName(shown.withColumn("_click", F.lit(0)), allowMissingColumns=True).repartition("dataset", "user_id")
    both = both.withColumn("_epoch", F.lit(0) if epoch_us is None else F.floor(F.col("us") / F.lit(epoch_us)))
    of_clicks = Window.partitionBy("dataset", "user_id", "_click").orderBy("us", "source_row", "hist_pos")
    listed = both.withColumn("_list", F.collect_list("_carried").over(of_clicks.rowsBetween(1 - n_recent, 0))).drop("_carried")
    before = user_order().rowsBetween(Window.unboundedPreceding, 0)
    return listed.withColumn("_recent", F.last(F.when(F.col("_click") == 1, F.col("_list")), ignorenulls=True).over(before)).drop("_list")


def user_order() -> WindowSpec:
    """The order of ``in_sequence``, which every window over it should share to be sorted once."""
    return Window.partitionBy("dataset", "user_id").orderBy("_epoch", "us", "_click", "source_row", "hist_pos")


def click_history(
    impressions: DataFrame, history: DataFrame, *, n_recent: int = N_RECENT_CLICKS, half_life: float = HALF_LIFE_DAYS,
    attributes: tuple[str, ...] = (),
) -> DataFrame:
    """Clicks strictly before each impression: count, days since the last, decayed sum, cold start, recent ids.

    Clicks and impressions of a user are one sequence, so the as-of semantics takes one shuffle, without a join of every
    click with every later impression.  The decayed sum is a windowed sum of weights relative to the start of their
    epoch, plus the whole epoch before; older clicks weigh less than a double can add to these.  Lists hold at most
    ``n_recent`` clicks; ``attributes`` names columns of ``history`` to list beside the ids (``recent_<name>``).
    """
    unit = half_life * DAY_US
    rows = in_sequence(distinct_impressions(impressions), history, ("article_id", *attributes), n_recent, epoch_us=unit * _EPOCH)
    is_click = F.col("_click") == 1
    before = user_order().rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("dataset", "user_id", "_epoch").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("dataset", "user_id").orderBy("_epoch").rangeBetween(-1, -1)
    weight = F.when(is_click, F.pow(F.lit(2.0), "shift"))
    seen = (
        rows.withColumn("shift", F.col("us") / F.lit(unit) - F.col("_epoch") * _EPOCH)
        .withColumn("n_clicks_before", F.count(F.when(is_click, 1)).over(before))
        .withColumn("last_us", F.max(F.when(is_click, F.col("us"))).over(before))
        .withColumn("weights", F.coalesce(F.sum(weight).over(own), F.lit(0.0)))
        .withColumn("older", F.coalesce(F.sum(weight).over(last), F.lit(0.0)))
        .where(~is_click)
    )
    lists = {
        f"recent_{plural}": F.coalesce(F.col(f"_recent.{c}"), F.array().cast(f"array<{history.schema[c].dataType.simpleString()}>"))
        for c, plural in (("article_id", "article_ids"), *((c, _PLURAL.get(c, c)) for c in attributes))
    }
    return seen.select(
        "impression_id", "dataset", "user_id", "us", "n_clicks_before",
        ((F.col("us") - F.col("last_us")) / F.lit(DAY_US)).alias("days_since_last_click"),
        F.coalesce(
            (F.col("weights") + F.col("older") * F.lit(2.0**-_EPOCH)) * F.pow(F.lit(2.0), -F.col("shift")), F.lit(0.0)
        ).alias("recency_weighted_click_count"),
        (F.col("n_clicks_before") <= COLD_START_MAX_CLICKS).alias("is_cold_start"),
        *(column.alias(name) for name, column in lists.items()),
    )


def with_attributes(history: DataFrame, articles: DataFrame, *columns: str) -> DataFrame:
    """Clicks with columns of their articles; null where the article is unknown."""
    known = articles.groupBy("dataset", "article_id").agg(*(F.min(c).alias(c) for c in columns))
    return history.join(known, ["dataset", "article_id"], "left")


def recent_attributes(clicks: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds recent titles and categories in click order; unknown articles keep their place as nulls."""
    known = articles.groupBy("dataset", "article_id").agg(F.min("title").alias("title"), F.min("category").alias("category"))
    places = clicks.select("impression_id", "dataset", F.posexplode("recent_article_ids").alias("at", "article_id"))
    listed = places.join(known, ["dataset", "article_id"], "left").groupBy("impression_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "title", "category"))).alias("r")
    )
    empty = F.array().cast("array<string>")
    return clicks.join(listed, "impression_id", "left").withColumn(
        "recent_titles", F.coalesce(F.transform("r", lambda x: x["title"]), empty)
    ).withColumn("recent_categories", F.coalesce(F.transform("r", lambda x: x["category"]), empty)).drop("r")


def pooled(listed: Column) -> Column:
    """Mean of the known vectors of a list, renormalised; null if there is none."""
    known = F.filter(listed, lambda v: v.isNotNull())

    def mean(vs: Column) -> Column:
        wide = F.transform(F.get(vs, 0), lambda x: x.cast("double"))
        rest = F.slice(vs, F.lit(2), F.greatest(F.size(vs) - 1, F.lit(0)))
        total = F.aggregate(rest, wide, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
        return F.when(F.size(vs) > 0, normalised(F.transform(total, lambda x: x / F.size(vs))))

    return held(known, mean)


def history_vectors(clicks: DataFrame, vectors: DataFrame, *, id_col: str = "impression_id", ids: str = "recent_article_ids") -> DataFrame:
    """``id_col, history_vec``: mean of the known vectors of the listed articles, renormalised; absent if none.

    Vectors travel whole, so rows are listed articles that have a vector, never their dimensions.
    """
    places = clicks.select(id_col, F.posexplode(ids).alias("at", "article_id"))
    listed = places.join(vectors.select("article_id", "vec"), "article_id").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", "vec"))).alias("r"))
    return listed.select(id_col, pooled(F.col("r.vec")).alias("history_vec"))


def sessions(impressions: DataFrame, *, gap_minutes: float = SESSION_GAP_MINUTES) -> DataFrame:
    """Session key, clicks and impressions earlier in the session, mean read time of the user's earlier impressions.

    A native session id wins over one derived from gaps longer than ``gap_minutes``.  Rows at the same instant follow
    their impression ids.
    """
    one = impressions.groupBy("impression_id").agg(
        *(F.min(c).alias(c) for c in ("dataset", "user_id", "us", "session_id", "read_time")),
        F.max("clicked").alias("had_click"),
    )
    user = Window.partitionBy("dataset", "user_id").orderBy("us", "impression_id")
    opens = F.coalesce((F.col("us") - F.lag("us").over(user)) > gap_minutes * MINUTE_US, F.lit(True))
    derived = (
        one.withColumn("opens", opens.cast("int"))
        .withColumn("derived", F.sum("opens").over(user.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("avg_dwell_time_before", F.avg("read_time").over(user.rowsBetween(Window.unboundedPreceding, -1)))
    )
    key = F.when(
        F.col("session_id").isNotNull(), F.concat("dataset", F.lit("_u"), "user_id", F.lit("_sid"), "session_id")
    ).otherwise(F.concat("dataset", F.lit("_u"), "user_id", F.lit("_dsid"), F.col("derived").cast("string")))
    # A session is of one user, so its rows are where the user's are.
    earlier = Window.partitionBy("dataset", "user_id", "session_key").orderBy("us", "impression_id").rowsBetween(Window.unboundedPreceding, -1)
    return derived.withColumn("session_key", key).select(
        "impression_id", "dataset", "user_id", "us", "session_key",
        F.coalesce(F.sum("had_click").over(earlier), F.lit(0)).alias("session_click_count_before"),
        F.count(F.lit(1)).over(earlier).alias("session_impressions_before"),
        "avg_dwell_time_before",
    )


def article_popularity(impressions: DataFrame) -> DataFrame:
    """Adds clicks and impressions of the article strictly before the candidate's instant, and their ratio.

    Candidates move once, to their article.  Where articles of a bucket have more than HOT_ROWS candidates (counted
    beforehand; at most 65,536 numbers reach the driver), they are first summed by (article, instant) with map-side
    combining, so a hot article costs a row per instant in the window and its candidates stay spread by instant in the
    join back.  A candidate without a time stays, with null counts, and counts for no other.
    """
    bucket = F.pmod(F.xxhash64("dataset", "article_id"), F.lit(_BUCKETS))
    counted = impressions.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    hot = [r["b"] for r in counted.where(F.col("n") > HOT_ROWS).select("b").collect()]
    before = Window.partitionBy("dataset", "article_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    timed = F.col("us").isNotNull()
    spread = impressions.where(~bucket.isin(hot)) if hot else impressions
    running = spread.withColumn(
        "cum_clicks_prior", F.when(timed, F.coalesce(F.sum(F.when(timed, F.col("clicked"))).over(before), F.lit(0)))
    ).withColumn("cum_impressions_prior", F.when(timed, F.count(F.when(timed, 1)).over(before)))
    if hot:
        running = running.unionByName(_by_instant(impressions.where(bucket.isin(hot))))
    return running.withColumn("popularity_prior_ctr", ratio(F.col("cum_clicks_prior"), F.col("cum_impressions_prior")))


def _by_instant(impressions: DataFrame) -> DataFrame:
    keys = ["dataset", "article_id", "us"]
    instants = impressions.where("us is not null").groupBy(*keys).agg(F.sum("clicked").alias("c"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("dataset", "article_id").orderBy("us").rowsBetween(Window.unboundedPreceding, -1)
    running = instants.select(
        *keys,
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("cum_clicks_prior"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cum_impressions_prior"),
    )
    columns = [c for c in impressions.columns if c not in keys]
    return impressions.join(running, keys, "left").select(*keys, *columns, "cum_clicks_prior", "cum_impressions_prior")


def freshness(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds category and hours since publication; null where unknown or published after being shown."""
    known = articles.groupBy("dataset", "article_id").agg(
        F.min("category").alias("category"), F.min("published_us").alias("published_us")
    )
    hours = (F.col("us") - F.col("published_us")) / F.lit(HOUR_US)
    return candidates.join(known, ["dataset", "article_id"], "left").withColumn(
        "freshness_hours", F.when(hours >= 0, hours)
    ).drop("published_us")


def category_match(candidates: DataFrame, clicks: DataFrame, *, count_unknown: bool = True) -> DataFrame:
    """Adds whether, and what fraction of, the user's recent categories are the candidate's.

    ``count_unknown`` keeps clicks of unknown category in the denominator, as feature building does; serving doesn't.
    """
    lists = clicks.select("impression_id", "recent_categories")
    known = F.filter("recent_categories", lambda c: c.isNotNull())
    same = F.size(F.filter("recent_categories", lambda c: c == F.col("category")))
    size = F.size("recent_categories") if count_unknown else F.size(known)
    return (
        candidates.join(lists, "impression_id", "left")
        .withColumn("category_match", F.coalesce(same > 0, F.lit(False)) & F.col("recent_categories").isNotNull())
        .withColumn("category_match_frac", F.when(size > 0, F.greatest(same, F.lit(0)) / size))
        .drop("recent_categories")
    )


def position_prior(impressions: DataFrame) -> DataFrame:
    """Click rate by dataset and position, from the train split only."""
    return impressions.where("split = 'train'").groupBy("dataset", "position").agg(F.avg("clicked").alias("position_ctr_prior"))


def behavioral(impressions: DataFrame, history: DataFrame, articles: DataFrame, *, gap_minutes: float = SESSION_GAP_MINUTES) -> DataFrame:
    """The candidate-grain feature table; lists stay at impression grain and never multiply by candidates."""
    clicks = click_history(impressions, with_attributes(history, articles, "category"), attributes=("category",))
    candidates = category_match(freshness(article_popularity(impressions), articles), clicks)
    scalars = clicks.select(
        "impression_id", "n_clicks_before", "days_since_last_click", "recency_weighted_click_count", "is_cold_start"
    )
    visits = sessions(impressions, gap_minutes=gap_minutes).select(
        "impression_id", "session_click_count_before", "session_impressions_before", "avg_dwell_time_before"
    )
    return (
        candidates.join(scalars, "impression_id", "left")
        .join(visits, "impression_id", "left")
        .join(few(position_prior(impressions), 100_000), ["dataset", "position"], "left")
    )


def leakage(features: DataFrame) -> DataFrame:
    """Counts of rows that break an invariant: all are zero in a sound table."""
    rules = {
        "negative_clicks": "n_clicks_before < 0",
        "negative_days": "days_since_last_click <= 0",
        "clicks_over_impressions": "cum_clicks_prior > cum_impressions_prior",
        "negative_freshness": "freshness_hours < 0",
        "session_clicks_over_impressions": "session_click_count_before > session_impressions_before",
    }
    return features.agg(*(F.count(F.when(F.expr(rule), 1)).alias(name) for name, rule in rules.items()))


def assert_no_leakage(features: DataFrame) -> None:
    """Raises ValueError where an invariant is broken."""
    broken = {k: v for k, v in leakage(features).first().asDict().items() if v}
    if broken:
        raise ValueError(f"rows that see the future: {broken}")


def feature_means(features: DataFrame) -> DataFrame:
    """Means of the scalar features by dataset."""
    columns = ("n_clicks_before", "popularity_prior_ctr", "freshness_hours", "category_match_frac", "session_impressions_before")
    return features.groupBy("dataset").agg(
        *(F.avg(c).alias(c) for c in columns), F.avg(F.col("is_cold_start").cast("double")).alias("cold_start_share")
    )
