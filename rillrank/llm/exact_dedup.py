"""Exact dedup (1): group by a 128-bit content hash, compare bytes inside groups, keep one row of each content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillrank.llm.common import written

#: The white space that normalisation deletes: space and the control characters 0x09-0x0D.
WHITE_SPACE = " \t\n\x0b\f\r"

#: 10^20: above the range of any 64-bit id, so that length * STEP + (offset - id) orders by (length desc, id asc).
_STEP = "100000000000000000000"
_TOP = "9223372036854775807"


#: Largest groups whose rows are joined by broadcast.
HOT_GROUPS = 1000


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def exact_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = lambda norm: F.unhex(F.md5(norm)),
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Contents are equal when their normalised bytes are.  Rows are grouped on the 128-bit hash *and* the bytes, so two
    contents whose hashes collide stay apart; map-side partial aggregation folds a hot content to one row per task.
    The row with the longest original text (code points), then the smallest id, is kept; ``group_size`` counts rows.

    Edge cases: null and white-space-only texts form one group (the empty content).  Rows that repeat an id and text
    are each counted and all of them are ``kept`` when that id is (they are the same document).  Where rows share an
    id but differ in text, each is judged by its own content.  A null id sorts after all others and is kept only when
    its group has no other; the kept id is then null.  An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    hashed = rows.select(
        "id", F.length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("norm")
    ).select("id", "n", "norm", content_hash(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("digest"))
    # The largest (length, -id) of a group as one decimal: a fixed-width buffer keeps this a hash aggregation.
    order = F.expr(f"cast(n as decimal(38,0)) * {_STEP} + ({_TOP} - cast(id as decimal(20,0)))")
    contents = (
        hashed.select("h", "norm", order.alias("best"))
        .groupBy("h", "norm")
        .agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
    )
    keepers = contents.select(
        F.col("h").alias("group_h"),
        F.unhex(F.sha2("norm", 256)).alias("group_digest"),
        F.expr(f"cast({_TOP} - pmod(best, cast({_STEP} as decimal(38,0))) as long)").alias("group_keep"),
        "size",
    )
    # Written, as two joins read it: a row of fixed width for each content that repeats, without its text.
    keepers = written(keepers, "keepers")
    # Rows of the largest groups find their keeper without a shuffle; of what is left, no group is more than one in
    # HOT_GROUPS of all rows.  HOT_GROUPS rows of fixed width are broadcast, whatever the table's size.
    hot = keepers.orderBy(F.desc("size"), "group_h", "group_digest").limit(HOT_GROUPS).select(
        F.col("group_h").alias("hot_h"), F.col("group_digest").alias("hot_digest"), F.col("group_keep").alias("hot_keep"),
        F.col("size").alias("hot_size"),
    )
    members = hashed.select("id", "h", "digest")
    members = members.join(
        F.broadcast(hot), (members.h == hot.hot_h) & (members.digest == hot.hot_digest), "left"
    )
    # Where the keeper is found, a key that no content's digest has and that spreads the rows.
    key = F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.xxhash64("id"))))
    members = members.withColumn("key", key)
    joined = members.join(
        keepers, (members.h == keepers.group_h) & (members.key == keepers.group_digest), "left"
    )
    # A group's keeper may have a null id, so sizes tell which join found it.
    keep = (
        F.when(F.col("hot_size").isNotNull(), F.col("hot_keep"))
        .when(F.col("size").isNotNull(), F.col("group_keep"))
        .otherwise(F.col("id"))
    )
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("hot_size", "size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
