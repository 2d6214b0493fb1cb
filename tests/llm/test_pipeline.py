"""The pipeline's stages, each on its own input, against plain versions."""

import public_tokenizers
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import broadcasts, brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        path = str(tmp_path / str(len(seen)))
        out.write.parquet(path)
        seen[name] = (docs, spark.read.parquet(path))
        docs = seen[name][1]
    strip = str.maketrans("", "", " \t\n\x0b\f\r")
    before, after = map(rows, seen["exact dedup"])
    best = {}
    for i, t in before:
        key = (t or "").translate(strip)
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
    assert {i for i, _ in after} == {i for _, i in best.values()}
    before, after = map(rows, seen["MinHash near-dedup"])
    assert {i for i, _ in after} == {i for i, (_, _, kept) in brute.near(before, 80).items() if kept}
    before, after = map(rows, seen["benchmark decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = brute.leaks(before, items)
    clean = {i: t for i, t in before if not leaks[i][1]}
    kept = dict(after)
    assert all(kept.get(i) == t for i, t in clean.items())
    assert not any(v[4] for v in brute.leaks(after, items).values())
    before, after = seen["SentencePiece encoding"]
    plain = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {r.doc_id: r.piece_ids for r in after.collect()}
    assert pieces == {i: plain.encode(t or "") for i, t in rows(before)}


def test_near_stage_broadcasts_no_table(spark):
    """Only keys of dropped rows besides what the operator may broadcast, at Spark's own threshold."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = broadcasts.columns(spark, lambda: pipeline.near_stage(spark, docs, SF).collect())
    assert "hot_fingerprint" in found and found <= broadcasts.SMALL | {"row_key"}


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.readwriter import DataFrameWriter

    in_python = ("MapInArrow", "FlatMapGroupsInPandas", "ArrowEvalPython")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    seen = []

    def note(df):
        if any(x in plan(df) for x in in_python):
            seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))

    collect, parquet = DataFrame.collect, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrame, "collect", lambda self: (note(self), collect(self))[1])
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (note(self._df), parquet(self, *a, **b))[1])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES:
        seen.clear()
        out = stage(spark, docs, SF)
        assert max(seen, default=0) <= 1000 and (seen or stage is pipeline.exact_stage), name
        assert not any(x in plan(out) for x in in_python), name
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000


def test_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same text here", "en", "s", 14), (3, "same text here", "en", "s", 14), (None, "other words", None, "s", 11)], schema
    )
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    assert sorted(r.text or "" for r in docs.collect()) == ["", "other words", "same text here"]
    empty = spark.createDataFrame([], schema)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by(stage, spark, pairs):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in pairs], SCHEMA)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    return sorted(rows(out), key=repr)


def test_null_and_repeated_ids_are_judged_by_their_own_text(spark):
    pairs = [(1, "a"), (None, "a"), (None, "b"), (3, "a"), (3, "c"), (3, "c"), (None, "d"), (None, "d")]
    want = [(1, "a"), (None, "b"), (3, "c"), (None, "d")]
    assert kept_by(pipeline.exact_stage, spark, pairs) == sorted(want, key=repr)
    base = " ".join(f"word{i}" for i in range(200))
    other, third = base.replace("word", "term"), base.replace("word", "name")
    pairs = [(1, base), (5, base + " end"), (5, other), (None, base + " more"), (None, third)]
    assert kept_by(pipeline.near_stage, spark, pairs) == sorted([(1, base), (5, other), (None, third)], key=repr)


def test_quality_of_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = pipeline.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).join(docs, "doc_id").orderBy("log_weight").collect()
    bad, good = judged[0].text, judged[-1].text
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i in (None, 10**7) for t in (bad, good)], SCHEMA)
    out = pipeline.quality_stage(spark, docs.unionByName(more.select(docs.columns)), SF)
    assert sorted(rows(out.where(f"doc_id is null or doc_id = {10**7}")), key=repr) == sorted([(None, good), (10**7, good)], key=repr)
