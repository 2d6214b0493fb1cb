"""Constants of the feature, retrieval and ranking operators."""

# Fixed values that results depend on.
N_RECENT_CLICKS = 10
N_RECENT_QUERY = 5
HALF_LIFE_DAYS = 7.0
COLD_START_MAX_CLICKS = 5
SESSION_GAP_MINUTES = 30.0
BM25_K1 = 1.5
BM25_B = 0.75
RECALL_KS = (50, 100, 200)
STAGE1_K = 150
RECLIST_K = 10
HEAD_PERCENTILE = 0.8
BOOTSTRAP_ROUNDS = 1000
BOOTSTRAP_LEVEL = 0.95
SEED = 42
ALPHAS = tuple(i / 10 for i in range(11))
TREES = 200
LEARNING_RATE = 0.05
TREE_DEPTH = 5
MIN_LEAF_ROWS = 20

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000

FEATURES = (
    "bm25_score", "semantic_score", "n_clicks_before", "recency_weighted_click_count", "is_cold_start",
    "popularity_prior_ctr", "freshness_hours", "category_match", "category_match_frac", "session_click_count_before",
    "session_impressions_before", "avg_dwell_time_before", "position_ctr_prior", "position",
)
