"""Point-in-time scenarios: nothing at or after an impression's instant is seen."""

import pytest
from pyspark.sql import functions as F

from rillrank.config import DAY_US, HOUR_US, MINUTE_US
from rillrank.operators import behavioral as bh

IMP = "impression_id string, dataset string, user_id string, article_id string, us long, clicked int, position int, session_id string, read_time double, split string"
HIST = "dataset string, user_id string, article_id string, us long, source_row long, hist_pos int"
ART = "article_id string, dataset string, title string, category string, published_us long"


@pytest.fixture
def articles(spark):
    return spark.createDataFrame(
        [("a1", "d", "A1", "sports", 0), ("a2", "d", "A2", "sports", DAY_US), ("a3", "d", "A3", "news", 9 * DAY_US)], ART
    )


@pytest.fixture
def history(spark):
    return spark.createDataFrame([("d", "u1", "a1", 2 * DAY_US, 0, 0), ("d", "u1", "a2", 3 * DAY_US, 1, 0)], HIST)


def imp(spark, *rows):
    return spark.createDataFrame([(i, "d", u, a, t, c, p, s, None, "train") for i, u, a, t, c, p, s in rows], IMP)


def test_clicks_strictly_before(spark, history, articles):
    shown = imp(spark, ("i1", "u1", "a3", 2 * DAY_US + 2 * HOUR_US, 0, 0, None), ("i0", "u1", "a3", 2 * DAY_US, 0, 0, None))
    out = {r.impression_id: r for r in bh.recent_attributes(bh.click_history(shown, history), articles).collect()}
    assert out["i1"].n_clicks_before == 1 and out["i1"].recent_titles == ["A1"]
    assert out["i1"].days_since_last_click == pytest.approx(2 / 24)
    assert out["i1"].recency_weighted_click_count == pytest.approx(0.5 ** (2 / 24 / 7))
    assert out["i0"].n_clicks_before == 0  # a click at the very instant isn't seen


def test_cold_start(spark, history):
    row = bh.click_history(imp(spark, ("i1", "u9", "a1", DAY_US, 0, 0, None)), history).first()
    assert (row.n_clicks_before, row.recent_article_ids, row.is_cold_start, row.days_since_last_click) == (0, [], True, None)
    assert row.recency_weighted_click_count == 0.0


def test_popularity_ties(spark):
    shown = imp(spark, ("i1", "u1", "a1", DAY_US, 1, 0, None), ("i2", "u2", "a1", DAY_US, 0, 0, None), ("i3", "u3", "a1", 2 * DAY_US, 0, 0, None))
    out = {r.impression_id: (r.cum_clicks_prior, r.cum_impressions_prior, r.popularity_prior_ctr) for r in bh.article_popularity(shown).collect()}
    assert out == {"i1": (0, 0, None), "i2": (0, 0, None), "i3": (1, 2, 0.5)}


def test_no_negative_freshness(spark, articles):
    assert bh.freshness(imp(spark, ("i1", "u1", "a3", 0, 0, 0, None)), articles).first().freshness_hours is None


def test_session_counts(spark):
    shown = imp(spark, ("i1", "u1", "a1", 0, 1, 0, "s"), ("i2", "u1", "a1", 5 * MINUTE_US, 0, 0, "s"), ("i3", "u1", "a1", 10 * MINUTE_US, 1, 0, "s"))
    out = {r.impression_id: r.session_click_count_before for r in bh.sessions(shown).collect()}
    assert out == {"i1": 0, "i2": 1, "i3": 1}


def test_session_gap_is_strict(spark):
    gap = 30 * MINUTE_US
    shown = imp(spark, ("i1", "u1", "a1", 0, 0, 0, None), ("i2", "u1", "a1", gap, 0, 0, None), ("i3", "u1", "a1", 2 * gap + 1, 0, 0, None))
    out = {r.impression_id: r.session_impressions_before for r in bh.sessions(shown).collect()}
    assert out == {"i1": 0, "i2": 1, "i3": 0}


def test_history_vector(spark, history):
    vectors = spark.createDataFrame([("a1", [1.0, 0.0]), ("a2", [0.0, 1.0])], "article_id string, vec array<double>")
    clicks = bh.click_history(imp(spark, ("i1", "u1", "a3", 2 * DAY_US + HOUR_US, 0, 0, None), ("i2", "u1", "a3", 5 * DAY_US, 0, 0, None)), history)
    out = {r.impression_id: r.history_vec for r in bh.history_vectors(clicks, vectors).collect()}
    assert out["i1"] == [1.0, 0.0]
    assert out["i2"] == pytest.approx([0.5**0.5, 0.5**0.5])


def test_composed_table_does_not_leak(spark, history, articles):
    shown = imp(spark, *((f"i{k}", "u1", f"a{k % 3 + 1}", k * DAY_US, k % 2, k % 3, None) for k in range(12)))
    table = bh.behavioral(shown, history, articles)
    bh.assert_no_leakage(table)
    assert table.count() == 12
    with pytest.raises(ValueError, match="negative_freshness"):
        bh.assert_no_leakage(table.withColumn("freshness_hours", F.lit(-1.0)))


def test_later_events_change_nothing_earlier(spark, history, articles):
    shown = imp(spark, *((f"i{k}", "u1", f"a{k % 3 + 1}", k * DAY_US, k % 2, 0, None) for k in range(6)))
    later = imp(spark, ("z", "u1", "a1", 9 * DAY_US, 1, 0, None))
    names = ["impression_id", "cum_clicks_prior", "n_clicks_before", "session_impressions_before", "category_match"]
    before = {tuple(r) for r in bh.behavioral(shown, history, articles).select(names).collect()}
    more = history.union(spark.createDataFrame([("d", "u1", "a3", 8 * DAY_US, 5, 0)], HIST))
    after = {tuple(r) for r in bh.behavioral(shown.union(later).repartition(3), more, articles).where("impression_id != 'z'").select(names).collect()}
    assert before == after


def test_decay_over_many_half_lives(spark):
    """Clicks an hour apart and a half-life of a minute: sums span thousands of half-lives."""
    hour = 3_600_000_000
    history = spark.createDataFrame([("d", "u", f"a{i}", i * hour, 0, i) for i in range(400)], "dataset string, user_id string, article_id string, us long, source_row long, hist_pos int")
    shown = spark.createDataFrame([(f"i{i}", "d", "u", "a", i * hour + 60_000_000) for i in range(400)], "impression_id string, dataset string, user_id string, article_id string, us long")
    for half_life in (1 / 1440, 1 / 24, 0.5):
        got = {r.impression_id: r.recency_weighted_click_count for r in bh.click_history(shown, history, half_life=half_life).collect()}
        for i in (0, 1, 57, 399):
            want = sum(0.5 ** (((i - j) * hour + 60_000_000) / (half_life * 86_400_000_000)) for j in range(i + 1))
            assert got[f"i{i}"] == pytest.approx(want)
