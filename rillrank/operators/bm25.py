"""BM25 retrieval over a postings table.

Postings carry precomputed weights, so a query is a sum over the lists of its distinct terms; persist them
(Parquet) before querying at scale.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillrank.config import BM25_B, BM25_K1
from rillrank.functions.columns import tokens

#: Postings of a block of documents, and query terms of a group of queries, that top_k holds at once.
BLOCK_POSTINGS = 2 << 20
GROUP_TERMS = 4 << 20
#: Tasks to share a search of few blocks, and the query terms that a group of it has at least.
TASKS, SMALL_GROUP_TERMS = 24, 1 << 14


def postings(texts: DataFrame, *, id_col: str = "article_id", text_col: str = "text", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """``id_col, term, tf, df, weight``; documents without tokens count in the number and mean length of documents."""
    lengths = texts.select(id_col, tokens(F.col(text_col)).alias("words")).withColumn("dl", F.size("words"))
    totals = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("mean_dl"))
    counted = lengths.select(id_col, "dl", F.explode("words").alias("term")).groupBy(id_col, "term").agg(
        F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")
    )
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # One row of totals, broadcast.
    joined = counted.join(df, "term").crossJoin(F.broadcast(totals))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    norm = F.lit(1 - b) + F.lit(b) * (F.col("dl") / F.col("mean_dl"))
    weight = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + F.lit(k1) * norm)
    return joined.select(id_col, "term", "tf", "df", weight.alias("weight"))


def query_terms(queries: DataFrame, *, query_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """Distinct terms of each query: how often a query repeats a term doesn't count."""
    return queries.select(query_col, F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))


def history_queries(clicks: DataFrame, texts: DataFrame, *, id_col: str, n_recent: int, ids: str = "click_history") -> DataFrame:
    """Distinct ``id_col, term`` of the texts of the last ``n_recent`` clicked articles; unknown articles are dropped."""
    from rillrank.functions.columns import last_n

    recent = clicks.select(id_col, F.explode(F.array_distinct(last_n(F.col(ids), n_recent))).alias("article_id"))
    words = texts.select("article_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return recent.join(words, "article_id").select(id_col, "term").distinct()


def packed(index: DataFrame, id_col: str = "article_id") -> DataFrame:
    """``id_col, _terms, _weights``: the postings of a document as two lists."""
    listed = index.groupBy(id_col).agg(F.collect_list(F.struct("term", "weight")).alias("p"))
    return listed.select(id_col, F.col("p.term").alias("_terms"), F.col("p.weight").alias("_weights"))


def matched(asked: Callable[[Column], Column]) -> Column:
    """Sum of ``_weights`` whose ``_terms`` are asked for; 0 where there are none."""
    met = F.zip_with("_terms", "_weights", lambda term, weight: F.when(asked(term), weight).otherwise(F.lit(0.0)))
    return F.coalesce(F.aggregate(met, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def folded(index: DataFrame, k: int, *, id_col: str = "article_id") -> DataFrame:
    """The postings without documents that can't be among any query's ``k`` best.

    Documents of equal terms and weights have equal scores whatever the query, so only the ``k`` first ids of each such
    class can be.  Classes are told apart by 128 bits of hash over the postings, and their number of terms.
    """
    one, other = F.xxhash64("term", "weight"), F.xxhash64("weight", F.lit(1), "term")
    kinds = index.groupBy(id_col).agg(F.bit_xor(one).alias("a"), F.bit_xor(other).alias("b"), F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("a", "b", "n").orderBy(id_col)
    kept = kinds.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k).select(id_col)
    return index.join(kept, id_col, "left_semi")


def top_k(terms: DataFrame, index: DataFrame, k: int, *, query_col: str = "query_id", id_col: str = "article_id") -> DataFrame:
    """``query_col, id_col, score, rank``: the best documents that share a term with the query, by exact scan.

    Blocks of whole documents (about BLOCK_POSTINGS postings) meet groups of queries, each packed into one row; a block
    sums each query's posting lists into an array and keeps its own k best, and the k best of these are the result.
    Rows are queries times blocks, never pairs of query and document.
    """
    count = max(-(-index.count() // BLOCK_POSTINGS), 1)
    asked_terms = terms.count()
    # As many groups as bound their size, and where blocks are few, as keep about TASKS tasks busy.
    parts = max(-(-asked_terms // GROUP_TERMS), min(-(-asked_terms // SMALL_GROUP_TERMS), -(-TASKS // count)), 1)
    packed = terms.groupBy(F.col(query_col).alias("q")).agg(F.collect_list("term").alias("words"))
    asked = packed.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts))).withColumn("block", F.explode(_upto(count)))
    blocks = index.select(F.col(id_col).alias("d"), "term", "weight")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("d"), F.lit(count))).withColumn("part", F.explode(_upto(parts)))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left.column("words").combine_chunks()
        words = pc.list_flatten(lists)
        known = words.unique()
        asked_at = pc.index_in(words, known).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = pc.index_in(right.column("term"), known)
        right = right.filter(pc.is_valid(at))
        term = at.drop_null().to_numpy()
        coded = right.column("d").combine_chunks().dictionary_encode("encode")
        # Documents are numbered in the order of their ids.
        in_order = pc.array_sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
        number = np.empty(len(in_order), dtype=np.intp)
        number[in_order] = np.arange(len(in_order))
        doc, weight = number[coded.indices.to_numpy()], right.column("weight").to_numpy()
        # Documents of equal postings (among the terms asked for) are one class, scored once: 128 bits tell classes apart.
        order = np.lexsort((term, doc))
        term, doc, weight = term[order], doc[order], weight[order]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, dtype=np.intp)
        marks = [np.diff(np.r_[first, len(doc)]).astype(np.uint64)]
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            x = (term.astype(np.uint64) + np.uint64(1)) * np.uint64(salt) ^ weight.view(np.uint64)
            for shift in (33, 29, 32):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(salt ^ 0x2545F4914F6CDD1E | 1)
            marks.append(np.add.reduceat(x, first) if len(first) else np.zeros(0, dtype=np.uint64))
        _, sample, kind = np.unique(np.stack(marks, axis=1), axis=0, return_index=True, return_inverse=True)
        kind = kind.reshape(-1)
        by_kind = np.argsort(kind, kind="stable")
        members, start_of = doc[first][by_kind] if len(first) else doc, np.searchsorted(kind[by_kind], np.arange(len(sample) + 1))
        sizes = np.minimum(np.diff(start_of), k)
        # The postings of one document of each class, by term.
        chosen = np.zeros(len(first), dtype=bool)
        chosen[sample] = True
        of_doc = np.repeat(np.arange(len(first)), marks[0].astype(np.intp))
        kept = chosen[of_doc]
        term, held_by, weight = term[kept], kind[of_doc[kept]], weight[kept]
        order = np.lexsort((held_by, term))
        term, held_by, weight = term[order], held_by[order], weight[order]
        bounds = np.searchsorted(term, np.arange(len(known) + 1))
        queries, docs, sums, ranks, start = [], [], [], [], 0
        for q, end in enumerate(ends):
            own = np.sort(asked_at[start:end])
            start = end
            spans = [slice(x, y) for x, y in zip(bounds[own].tolist(), bounds[own + 1].tolist(), strict=True)]
            held = np.concatenate([held_by[x] for x in spans])
            scores = np.bincount(held, np.concatenate([weight[x] for x in spans]), len(sample))
            # Weights are above 0, so a document that shares a term has a sum above 0.
            hit = np.flatnonzero(scores)
            rounded = np.round(scores[hit], 9)
            if len(hit) > k:
                near = rounded >= np.partition(rounded, len(hit) - k)[len(hit) - k]
                hit, rounded = hit[near], rounded[near]
            order = np.argsort(-rounded, kind="stable")
            hit, rounded = hit[order], rounded[order]
            # As many classes as hold k documents, and those that tie with the last of them.
            enough = np.searchsorted(np.cumsum(sizes[hit]), k)
            if enough < len(hit):
                last = np.searchsorted(-rounded, -rounded[enough], side="right")
                hit, rounded = hit[:last], rounded[:last]
            found = [members[start_of[c] : start_of[c] + sizes[c]] for c in hit]
            listed = np.concatenate(found) if found else np.zeros(0, dtype=np.intp)
            at = np.repeat(np.arange(len(hit)), sizes[hit])
            # Numbers of documents rise with their ids.
            best_of = np.lexsort((listed, -rounded[at]))[:k]
            queries.append(np.full(len(best_of), q))
            ranks.append(np.arange(1, len(best_of) + 1))
            docs.append(in_order[listed[best_of]])
            sums.append(scores[hit[at[best_of]]])
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (queries, docs, sums, ranks)]
        return pa.table({
            "q": left.column("q").combine_chunks().take(pa.array(flat[0].astype(np.int64))),
            "d": coded.dictionary.take(pa.array(flat[1].astype(np.int64))), "score": pa.array(flat[2], pa.float64()),
            "rank": pa.array(flat[3].astype(np.int32)),
        })

    types = {"q": terms.schema[query_col].dataType.simpleString(), "d": index.schema[id_col].dataType.simpleString()}
    scores = asked.groupBy("block", "part").cogroup(blocks.groupBy("block", "part")).applyInArrow(
        best, f"q {types['q']}, d {types['d']}, score double, rank int"
    ).select(F.col("q").alias(query_col), F.col("d").alias(id_col), "score", "rank")
    if count == 1:
        # A query's only block has its best in order.
        return scores
    at = Window.partitionBy(query_col).orderBy(F.desc(F.round("score", 9)), id_col)
    return scores.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def score_pairs(pairs: DataFrame, terms: DataFrame, index: DataFrame, *, query_col: str, out: str = "bm25_score") -> DataFrame:
    """Adds the score of each (query, article) pair of rows; 0 for unknown articles and queries without a match.

    A pair meets its document's postings and its query's terms as lists: no row is made per pair and term.
    """
    asked = terms.groupBy(query_col).agg(F.collect_set("term").alias("_asked"))
    joined = pairs.join(packed(index), "article_id", "left").join(asked, query_col, "left")
    score = matched(lambda term: F.coalesce(F.array_contains("_asked", term), F.lit(False)))
    return joined.withColumn(out, score).drop("_terms", "_weights", "_asked")
