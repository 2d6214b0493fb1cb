"""The registered queries' definitions in plain SQL, built from shared common table expressions."""

from __future__ import annotations

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: str, body: str) -> None:
    CTE[name] = (tuple(needs.split()), body)


def query(needs: str, final: str) -> str:
    """SQL of ``final`` with every expression it needs before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in CTE[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + final


def r6(x: str) -> str:
    """Six digits; the shift keeps exact halves, which day-granular data is full of, off the rounding boundary."""
    return f"round({x} + 1.3e-8, 6)"


_cte("imp", "", """
  SELECT CAST(l_orderkey AS VARCHAR) AS impression_id, CASE WHEN o_custkey % 2 = 1 THEN 'odd' ELSE 'even' END AS dataset,
         CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS article_id, epoch_us(o_orderdate) AS us,
         CAST(l_returnflag = 'R' AS INTEGER) AS clicked,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS INTEGER) AS position,
         CASE WHEN o_custkey % 2 = 1 THEN o_totalprice END AS read_time
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
_cte("hist", "imp", """
  SELECT dataset, user_id, article_id, us, CAST(impression_id AS BIGINT) AS source_row, position AS hist_pos
  FROM imp WHERE clicked = 1""")
_cte("art", "", """
  SELECT CAST(p_partkey AS VARCHAR) AS article_id, p_name AS title, p_brand AS abstract, p_type AS category,
         p_brand AS subcategory, p_brand || '|' || CAST(p_size AS VARCHAR) AS entities, epoch_us(first) AS published_us, d.dataset
  FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS first FROM lineitem GROUP BY 1) s ON p_partkey = l_partkey
  CROSS JOIN (VALUES ('even'), ('odd')) d(dataset)""")
_cte("spl", "imp", """
  SELECT imp.*, CASE WHEN us >= top - t * 86400000000 THEN 'test' WHEN us >= top - 2 * t * 86400000000 THEN 'val' ELSE 'train' END AS split
  FROM imp JOIN (SELECT dataset, max(us) AS top, CASE WHEN dataset = 'even' THEN 60 ELSE 120 END AS t FROM imp GROUP BY dataset) USING (dataset)""")
_cte("one", "imp", """
  SELECT impression_id, min(dataset) AS dataset, min(user_id) AS user_id, min(us) AS us, min(read_time) AS read_time,
         max(clicked) AS had_click FROM imp GROUP BY impression_id""")
_cte("num", "hist", """
  SELECT *, row_number() OVER (PARTITION BY dataset, user_id ORDER BY us, source_row, hist_pos) AS k FROM hist""")
_cte("clk", "one num", """
  SELECT o.impression_id, o.dataset, o.user_id, o.us, count(n.k) AS n_clicks_before, max(n.us) AS last_us,
         coalesce(sum(pow(0.5, (o.us - n.us) / 604800000000.0)), 0.0) AS decayed
  FROM one o LEFT JOIN num n ON o.dataset = n.dataset AND o.user_id = n.user_id AND n.us < o.us
  GROUP BY ALL""")
_cte("rec", "clk num", """
  SELECT c.impression_id, c.dataset, n.k, n.article_id FROM clk c JOIN num n
  ON c.dataset = n.dataset AND c.user_id = n.user_id AND n.k BETWEEN c.n_clicks_before - 9 AND c.n_clicks_before""")
_cte("recat", "rec art", "SELECT rec.*, title, category FROM rec LEFT JOIN art USING (dataset, article_id)")
_cte("pop", "spl", """
  SELECT *, coalesce(sum(clicked) OVER w, 0) AS cum_clicks_prior, count(*) OVER w AS cum_impressions_prior FROM spl
  WINDOW w AS (PARTITION BY dataset, article_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
_cte("fresh", "pop art", """
  SELECT pop.*, cum_clicks_prior / nullif(CAST(cum_impressions_prior AS DOUBLE), 0) AS ctr, art.category,
         CASE WHEN us >= published_us THEN (us - published_us) / 3600000000.0 END AS freshness_hours
  FROM pop LEFT JOIN art USING (dataset, article_id)""")
_cte("catm", "fresh recat", """
  SELECT f.*, coalesce(m.same, 0) > 0 AS category_match,
         CASE WHEN l.n > 0 THEN CAST(coalesce(m.same, 0) AS DOUBLE) / l.n END AS category_match_frac
  FROM fresh f LEFT JOIN (SELECT impression_id, category, count(*) AS same FROM recat GROUP BY ALL) m USING (impression_id, category)
  LEFT JOIN (SELECT impression_id, count(*) AS n FROM recat GROUP BY ALL) l USING (impression_id)""")
_cte("ses0", "one", """
  SELECT *, CASE WHEN us - lag(us) OVER u > {gap} THEN 1 WHEN lag(us) OVER u IS NULL THEN 1 ELSE 0 END AS opens,
         avg(read_time) OVER (PARTITION BY dataset, user_id ORDER BY us, impression_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dwell
  FROM one WINDOW u AS (PARTITION BY dataset, user_id ORDER BY us, impression_id)""".replace("{gap}", str(43200 * 60_000_000)))
_cte("ses1", "ses0", """
  SELECT *, dataset || '_u' || user_id || '_dsid' || CAST(CAST(sum(opens) OVER (PARTITION BY dataset, user_id ORDER BY us, impression_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS VARCHAR) AS session_key FROM ses0""")
_cte("ses", "ses1", """
  SELECT *, CAST(coalesce(sum(had_click) OVER w, 0) AS BIGINT) AS clicks_before, count(*) OVER w AS impressions_before FROM ses1
  WINDOW w AS (PARTITION BY session_key ORDER BY us, impression_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
_cte("pri", "spl", "SELECT dataset, position, avg(clicked) AS prior FROM spl WHERE split = 'train' GROUP BY ALL")
_cte("scored", "fresh", "SELECT *, coalesce(ctr, 0.0) AS score FROM fresh")


def judged(table: str, score: str, keys: str = "impression_id") -> str:
    """Body of an expression that judges a scored table per key."""
    return f"""
  SELECT {keys}, count(*) AS n, sum(clicked) AS p,
         (sum(CASE WHEN clicked = 1 THEN low + (ties - 1) / 2.0 END) - sum(clicked) * (sum(clicked) + 1) / 2.0)
           / nullif(CAST(sum(clicked) * (count(*) - sum(clicked)) AS DOUBLE), 0) AS auc,
         1.0 / min(CASE WHEN clicked = 1 THEN rk END) AS mrr,
         coalesce(sum(CASE WHEN clicked = 1 AND rk <= 5 THEN 1 / log2(rk + 1.0) END), 0)
           / sum(CASE WHEN rk <= least(P, 5) THEN 1 / log2(rk + 1.0) END) AS ndcg5,
         coalesce(sum(CASE WHEN clicked = 1 AND rk <= 10 THEN 1 / log2(rk + 1.0) END), 0)
           / sum(CASE WHEN rk <= least(P, 10) THEN 1 / log2(rk + 1.0) END) AS ndcg10
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, position) AS rk,
               rank() OVER (PARTITION BY {keys} ORDER BY {score}) AS low,
               count(*) OVER (PARTITION BY {keys}, {score}) AS ties,
               sum(clicked) OVER (PARTITION BY {keys}) AS P FROM {table})
  GROUP BY {keys} HAVING count(*) >= 2 AND sum(clicked) > 0"""


_cte("jud", "scored", judged("scored", "score"))

# Lexical retrieval over article texts (one row per article) and over the documents.
_cte("txt", "art", "SELECT article_id, title || ' ' || abstract AS text FROM art WHERE dataset = 'even'")


def postings(name: str, source: str) -> None:
    needs = "txt" if source == "txt" else ""
    table = "txt" if source == "txt" else "(SELECT CAST(doc_id AS VARCHAR) AS article_id, text FROM documents)"
    _cte(f"{name}w", needs, rf"SELECT article_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS words FROM {table}")
    _cte(f"{name}t", f"{name}w", f"SELECT article_id, term, count(*) AS tf FROM (SELECT article_id, unnest(words) AS term FROM {name}w) GROUP BY ALL")
    _cte(f"{name}", f"{name}t", f"""
  SELECT t.article_id, term, tf, df,
         ln((docs - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (dl / mean_dl))) AS weight
  FROM {name}t t JOIN (SELECT term, count(*) AS df FROM {name}t GROUP BY ALL) USING (term)
  JOIN (SELECT article_id, len(words) AS dl FROM {name}w) l ON t.article_id = l.article_id
  CROSS JOIN (SELECT count(*) AS docs, avg(len(words)) AS mean_dl FROM {name}w)""")


postings("pst", "txt")
postings("dpst", "documents")
_cte("usr", "spl hist", """
  SELECT h.dataset, h.user_id, h.article_id, h.us, cutoff,
         row_number() OVER (PARTITION BY h.dataset, h.user_id ORDER BY h.us DESC, source_row DESC, hist_pos DESC) AS back,
         row_number() OVER (PARTITION BY h.dataset, h.user_id ORDER BY h.us, source_row, hist_pos) AS k
  FROM hist h JOIN (SELECT dataset, max(us) AS cutoff FROM spl WHERE split = 'train' GROUP BY dataset) c ON h.dataset = c.dataset AND h.us <= cutoff""")
_cte("cold", "usr", """
  SELECT dataset || '|' || user_id AS who, CASE WHEN n <= quantile_cont(n, 0.25) OVER (PARTITION BY dataset) THEN 'cold' ELSE 'warm' END AS slice
  FROM (SELECT dataset, user_id, count(*) AS n FROM usr GROUP BY ALL)""")
_cte("qry", "rec pstt clk", """
  SELECT DISTINCT impression_id, term FROM (SELECT rec.*, n_clicks_before FROM rec JOIN clk USING (impression_id)) x
  JOIN pstt t ON x.article_id = t.article_id WHERE k > n_clicks_before - 5""")
_cte("lex", "spl qry pst", """
  SELECT s.*, coalesce(b.score, 0.0) AS bm25_score FROM spl s LEFT JOIN (
    SELECT q.impression_id, p.article_id, sum(weight) AS score FROM qry q JOIN pst p USING (term)
    JOIN (SELECT DISTINCT impression_id, article_id FROM spl) c ON c.impression_id = q.impression_id AND c.article_id = p.article_id
    GROUP BY ALL) b USING (impression_id, article_id)""")
_cte("vec", "", "SELECT CAST(vec_id AS VARCHAR) AS article_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")
_cte("slot", "vec", "SELECT article_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vec")
_cte("hvec", "rec clk slot", """
  SELECT impression_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY impression_id)) AS x FROM (
    SELECT impression_id, d, avg(x) AS x FROM (SELECT rec.*, n_clicks_before FROM rec JOIN clk USING (impression_id)) r
    JOIN slot USING (article_id) WHERE k > n_clicks_before - 5 GROUP BY ALL)""")
_cte("lexsem", "lex hvec slot", """
  SELECT l.*, coalesce(s.score, 0.0) AS semantic_score FROM lex l LEFT JOIN (
    SELECT impression_id, c.article_id, sum(h.x * s.x) AS score FROM (SELECT DISTINCT impression_id, article_id FROM lex) c
    JOIN hvec h USING (impression_id) JOIN slot s ON s.article_id = c.article_id AND s.d = h.d GROUP BY ALL) s USING (impression_id, article_id)""")
_cte("norm", "lexsem", """
  SELECT *, CASE WHEN max(bm25_score) OVER w - min(bm25_score) OVER w >= 1e-12
                 THEN (bm25_score - min(bm25_score) OVER w) / (max(bm25_score) OVER w - min(bm25_score) OVER w) ELSE 0.0 END AS bm25_norm,
            CASE WHEN max(semantic_score) OVER w - min(semantic_score) OVER w >= 1e-12
                 THEN (semantic_score - min(semantic_score) OVER w) / (max(semantic_score) OVER w - min(semantic_score) OVER w) ELSE 0.0 END AS semantic_norm
  FROM lexsem WINDOW w AS (PARTITION BY impression_id)""")
_cte("list", "scored", """
  SELECT impression_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, position, article_id) AS rk FROM scored
  WHERE split = 'test') WHERE rk <= 10""")
_cte("tpop", "spl", "SELECT article_id, sum(clicked) AS clicks FROM spl WHERE split = 'train' GROUP BY ALL HAVING sum(clicked) > 0")
_cte("uqry", "usr pstt", """
  SELECT DISTINCT dataset || '|' || user_id AS who, term FROM usr JOIN pstt USING (article_id) WHERE back <= 5""")
_cte("utop", "uqry pst", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY round(score, 9) DESC, article_id) AS rk FROM (
    SELECT who, article_id, sum(weight) AS score FROM uqry JOIN pst USING (term) GROUP BY ALL)) WHERE rk <= 200""")
_cte("uvec", "usr slot", """
  SELECT who, d, x / sqrt(sum(x * x) OVER (PARTITION BY who)) AS x FROM (
    SELECT dataset || '|' || user_id AS who, d, avg(x) AS x FROM usr JOIN slot USING (article_id) WHERE back <= 5 GROUP BY ALL)""")
_cte("vtop", "uvec vec", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY round(score, 9) DESC, article_id) AS rk FROM (
    SELECT who, article_id, list_dot_product(u.v, vec.v) AS score
    FROM (SELECT who, list(x ORDER BY d) AS v FROM uvec GROUP BY who) u CROSS JOIN vec)) WHERE rk <= 200""")
_cte("truth", "spl", """
  SELECT DISTINCT dataset || '|' || user_id AS who, impression_id, article_id FROM spl WHERE split <> 'train' AND clicked = 1""")
