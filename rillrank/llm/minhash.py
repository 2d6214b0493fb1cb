"""MinHash near-dedup (4): an inverted join over signature coordinates.

1. Every whole text gives its set of word shingles, a 128-bit fingerprint of the set and a MinHash signature.  Texts
   with the same set form one class; only one row of a class goes on (a third of all rows may be one class).
2. Classes are posted under (coordinate, value) pairs.  Coordinates of a class are ordered from its rarest value to
   its most frequent one; two signatures that agree in at least ``matches`` coordinates must agree in one of the first
   ``coordinates - matches + 1`` of that order (prefix), so only these are posted, and values that a single class has
   are skipped.  Frequent values (shared lines, boilerplate) sink to the end of the order and are hardly ever posted.
3. Posted classes that meet count their agreeing coordinates; pairs with at least ``matches`` are confirmed on the full
   sets by exact intersection.
4. A posting list longer than ``small`` isn't expanded into pairs.  It first meets its most central class only, and
   these links are joined to components.  Members of lists that aren't one component by then are posted once more, under
   the rarest shingles of their full sets: two sets of the required similarity share one of these, so texts of one
   template whose own parts differ don't meet again.  Short lists of shingles give pairs; a long one compares what
   stands outside its largest component with the whole list, block against block, and a block pair returns a spanning
   forest of its links, never all pairs.

Links are lost only where two sets of the given similarity agree in fewer than ``matches`` coordinates; the default is
the largest threshold that makes this chance at most 1e-6 a link (16 of 32 coordinates for similarity 0.85).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillrank.llm.common import merged, slices, written
from rillrank.llm.components import components
from rillrank.llm.shingles import shingle_sets, signatures

#: Posting lists up to this length are expanded into pairs; longer ones go by hub and blocks.
SMALL = 32
#: Classes, and shingles of their sets, in a block of a long list.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Counters of shingles that order them from rare to frequent: a table of 4 MB, whatever the number of shingles.
COUNTERS = 1 << 20
#: Largest classes whose rows find their component by a broadcast join.
HOT_CLASSES = 1000


def least_matches(percent: int, coordinates: int, miss: float = 1e-6) -> int:
    """The largest threshold that sets of this similarity fall below with a chance of at most ``miss``."""
    p, below = percent / 100, 0.0
    for m in range(coordinates + 1):
        below += math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if below > miss:
            return max(m, 1)
    return coordinates


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, coordinates: int) -> DataFrame:
    """``id, n, fingerprint, signature`` of every row; signature is null without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            coded = signatures(sets, coordinates).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                    pa.array([row if len(s) else None for s, row in zip(sets, coded)], pa.list_(pa.int32())),
                ],
                ["id", "n", "fingerprint", "signature"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(sketch, "id long, n long, fingerprint binary, signature array<int>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, fingerprint, shingles`` (packed 64-bit hashes, sorted) of the rows whose id is wanted."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            packed = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            digests = pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), digests, packed], ["id", "fingerprint", "shingles"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    rows = rows.join(wanted.select("id").distinct(), "id", "left_semi")
    return rows.mapInArrow(pack, "id long, fingerprint binary, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class keys whose full sets reach the similarity."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(merged(left), "a")
        .join(merged(right), "b")
        .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
        .select("a", "b")
    )


def _block_links(percent: int, matches: int):
    """Links between the loose classes and the members of one block pair, as a spanning forest."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        loose, members = group[group["side"] == 0], group[group["side"] == 1]
        found: list[tuple[int, int]] = []
        if len(loose) and len(members):
            # The forest starts from the components known so far: a pair inside one of them needs no test.
            top: dict[int, int] = {}

            def root(x: int) -> int:
                while top.setdefault(x, x) != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            ls = np.array(loose["signature"].to_list(), dtype=np.int32)
            ms = np.array(members["signature"].to_list(), dtype=np.int32)
            agree = sum((ls[:, c, None] == ms[None, :, c]).astype(np.int16) for c in range(ls.shape[1]))
            sets_l, sets_m = loose["shingles"].to_list(), members["shingles"].to_list()
            shared = np.intersect1d(np.concatenate(sets_l), np.concatenate(sets_m))
            both = np.zeros(agree.shape, dtype=np.float32)
            for start in range(0, len(shared), 4096):
                part = shared[start : start + 4096]
                both += _presence(sets_l, part) @ _presence(sets_m, part).T
            n_l, n_m = np.array([len(s) for s in sets_l]), np.array([len(s) for s in sets_m])
            good = (agree >= matches) & (100 * both >= percent * (n_l[:, None] + n_m[None, :] - both))
            keys_l, keys_m = loose["class"].to_numpy(), members["class"].to_numpy()
            of_l, of_m = loose["component"].to_numpy(), members["component"].to_numpy()
            for i, j in zip(*np.nonzero(good), strict=True):
                x, y = root(of_l[i]), root(of_m[j])
                if x != y:
                    top[max(x, y)] = min(x, y)
                    found.append((keys_l[i], keys_m[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return links


def _presence(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(part)), dtype=np.float32)
    for row, s in enumerate(sets):
        at = np.searchsorted(part, s)
        inside = at < len(part)
        at, s = at[inside], s[inside]
        out[row, at[part[at] == s]] = 1
    return out


def _parts(batches: Iterator[pa.RecordBatch], shingles: int = BLOCK_SHINGLES) -> Iterator[pa.RecordBatch]:
    """Cut batches into parts of at most so many shingles, one row at least."""
    for batch in batches:
        ends = batch.column("shingles").offsets.to_numpy()
        start = 0
        while start < batch.num_rows:
            end = max(int(np.searchsorted(ends, ends[start] + shingles, side="right")) - 1, start + 1)
            yield batch.slice(start, end - start)
            start = end


def _rare_shingles(members: DataFrame, percent: int) -> DataFrame:
    """``shingle, class, ...`` for the rarest shingles of each set, as many as sets of the similarity must share one of.

    Sets with |x & y| >= t |x | y| share at least t |x| of x's shingles, so one of the |x| - ceil(t |x|) + 1 first in an
    order common to all sets; the order goes by hashed counts over all members, and shingles of count 1 are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in _parts(batches):
            flat = batch.column("shingles").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            counts += np.bincount((flat % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["counter", "n"])

    totals = members.select("shingles").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    found = totals.toArrow()
    table = np.zeros(COUNTERS, dtype=np.uint32)
    table[found.column("counter").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**32 - 1)
    shared = members.sparkSession.sparkContext.broadcast(table)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in _parts(batches):
            sets, owners, firsts = batch.column("shingles"), [], []
            for row in range(batch.num_rows):
                own = sets[row].values.to_numpy(zero_copy_only=False).view(np.uint64)
                counts = table[(own % np.uint64(COUNTERS)).astype(np.int64)]
                take = len(own) - -(-percent * len(own) // 100) + 1
                first = np.lexsort((own, counts))[:take]
                first = first[counts[first] > 1]
                firsts.append(own[first].view(np.int64))
                owners.append(np.full(len(first), row))
            at = pa.array(np.concatenate(owners))
            rest = {name: batch.column(name).take(at) for name in batch.schema.names if name != "shingles"}
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate(firsts))} | rest)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields if f.name != "shingles")
    return members.mapInArrow(rarest, f"shingle long, {kept}")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 85,
    coordinates: int = 32,
    matches: int | None = None,
    small: int = SMALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept``.

    Rows are linked when ``100 * intersection >= percent * union`` of their shingle sets; ``component_id`` is the
    smallest id reachable through links, ``kept`` marks the row whose id that is.

    Edge cases: null, empty and blank texts have no shingles, link with nothing and are kept; a text below ``width``
    words has one shingle; identical texts (and texts with the same set) are linked; rows that repeat an id are each
    returned, with the smallest component of that id; a null id is its own component (null, not kept unless alone: it
    is never linked); an empty table gives an empty result; other columns are ignored.
    """
    matches = least_matches(percent, coordinates) if matches is None else matches
    rows = written(_sketches(docs, id_col, text_col, width, coordinates), "sketches")
    worded = rows.where("signature is not null and id is not null")
    # min() and first() fold a hot class map-side; its signature is any of its equal ones.
    classes = worded.groupBy("fingerprint").agg(
        F.min("id").alias("head"), F.max("n").alias("n"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("rows")
    )
    # One id may stand in several rows with different texts, so a class has a number of its own, fixed as it is written.
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    # Postings in order of rarity; values of one class only are skipped.
    posts = classes.select("class", F.posexplode("signature").alias("c", "v"))
    shared = posts.groupBy("c", "v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rarity = posts.join(merged(shared), ["c", "v"]).groupBy("class").agg(
        F.sort_array(F.collect_list(F.struct("df", "c", "v"))).alias("common")
    )
    # A class's prefix starts with its values of frequency one, which needn't be posted.
    prefix = coordinates - matches + 1
    taken = F.greatest(F.lit(0), prefix - (coordinates - F.size("common")))
    rarity = rarity.withColumn("central", F.aggregate("common", F.lit(0.0), lambda s, x: s + F.log(x["df"] + F.lit(1.0))))
    posted = (
        rarity.withColumn("common", F.slice("common", F.lit(1), taken))
        .select("class", "central", F.explode("common").alias("p"))
        .select("class", "central", "p.c", "p.v")
    )
    posted = written(posted, "postings")
    lists = posted.groupBy("c", "v").agg(
        F.count(F.lit(1)).alias("length"), F.max_by("class", F.struct("central", "class")).alias("hub")
    ).where("length > 1")
    lists = written(lists, "lists")
    sized = posted.join(merged(lists), ["c", "v"])
    carried = classes.select("class", "n", "signature")

    def met(pairs: DataFrame) -> DataFrame:
        """Pairs that agree in enough coordinates and whose sizes allow the similarity."""
        b = carried.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
        a = carried.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
        agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
        fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        return pairs.join(merged(a), "a").join(merged(b), "b").where(fits & (agree >= matches)).select("a", "b")

    short = sized.where(F.col("length") <= small).select("c", "v", "class")
    apart = short.select("c", "v", F.col("class").alias("a")).join(
        merged(short.select("c", "v", F.col("class").alias("b"))), ["c", "v"]
    ).where("a < b")
    hubs = sized.where((F.col("length") > small) & (F.col("class") != F.col("hub"))).select(
        F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")
    )
    pairs = written(met(apart.select("a", "b").union(hubs).distinct()), "pairs")

    long_lists = sized.where(F.col("length") > small).select("c", "v", "class")
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).union(
        long_lists.select("class")
    )
    heads = classes.join(wanted.distinct(), "class", "left_semi").select("class", "fingerprint", F.col("head").alias("id"))
    sets = _sets(docs, heads, id_col, text_col, width).join(merged(heads), ["id", "fingerprint"]).select("class", "shingles")
    sets = written(sets.dropDuplicates(["class"]), "sets")
    links = written(_confirmed(pairs, sets, percent), "confirmed")
    if not long_lists.isEmpty():
        links = links.union(written(_long_links(long_lists, links, sets, carried, met, percent, matches, small, block), "long"))

    # Links between classes become links between ids; an id that stands in several classes links their heads.
    heads_only = classes.select("class", "head")
    linked = links.join(merged(heads_only.select(F.col("class").alias("a"), F.col("head").alias("x"))), "a").join(
        merged(heads_only.select(F.col("class").alias("b"), F.col("head").alias("y"))), "b"
    ).select(F.col("x").alias("a"), F.col("y").alias("b"))
    several = worded.groupBy("id").agg(F.min("fingerprint").alias("least"), F.max("fingerprint").alias("most")).where("least < most")
    of_several = worded.select("id", "fingerprint").join(several.select("id"), "id").distinct().join(
        merged(classes.select("fingerprint", "head")), "fingerprint"
    )
    least = of_several.groupBy("id").agg(F.min("head").alias("least"))
    repeats = of_several.join(least, "id").where("head > least").select(F.col("head").alias("a"), F.col("least").alias("b"))
    found = components(linked.union(repeats))
    component_of = written(
        classes.select("fingerprint", "head", "rows").join(merged(found), F.col("head") == F.col("node"), "left").select(
            "fingerprint", "rows", F.coalesce("component", "head").alias("component")
        ),
        "components",
    )
    # Rows of the largest classes find their component without a shuffle; of what is left, no class is more than one in
    # HOT_CLASSES of all rows.  HOT_CLASSES rows of fixed width are broadcast, whatever the table's size.
    hot = component_of.orderBy(F.desc("rows"), "fingerprint").limit(HOT_CLASSES).select(
        F.col("fingerprint").alias("hot_fingerprint"), F.col("component").alias("hot_component")
    )
    own = F.when(F.col("signature").isNotNull() & F.col("id").isNotNull(), F.col("fingerprint"))
    rows = rows.select("id", "n", own.alias("own"))
    rows = rows.join(F.broadcast(hot), rows.own == hot.hot_fingerprint, "left")
    # Rows that are done, or have no class, get a key that no class has and that spreads them.
    open_ = F.col("hot_component").isNull() & F.col("own").isNotNull()
    rows = rows.withColumn("key", F.when(open_, F.col("own")).otherwise(F.unhex(F.hex(F.xxhash64("id")))))
    joined = rows.join(merged(component_of), rows.key == component_of.fingerprint, "left")
    component = F.coalesce("hot_component", "component", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def _long_links(
    lists: DataFrame, links: DataFrame, sets: DataFrame, carried: DataFrame, met: Callable[[DataFrame], DataFrame], percent: int,
    matches: int, small: int, block: int,
) -> DataFrame:
    """``a, b``: links among the members of long lists that join the components that ``links`` leave apart."""
    found = components(links).withColumnRenamed("node", "class")
    listed = written(
        lists.join(merged(found), "class", "left").select("c", "v", "class", F.coalesce("component", "class").alias("component")), "listed"
    )
    # Lists of one component need no more links; a class outside the largest component of a list is loose.
    main = _main(listed, "c", "v")
    lined = listed.join(merged(main.select("c", "v", "main")), ["c", "v"])
    members = lined.groupBy("class", "component").agg(F.max(F.col("component") != F.col("main")).alias("loose"))
    members = members.join(merged(carried.select("class", "n")), "class")
    posted = written(_rare_shingles(sets.join(merged(members), "class"), percent), "rare")
    told = posted.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("length"), F.max("loose").alias("any_loose"), F.min("component").alias("least"), F.max("component").alias("most")
    ).where("length > 1 and any_loose and least < most").select("shingle", "length")
    sized = posted.join(merged(told), "shingle")
    side = sized.where(F.col("length") <= small)
    pairs = side.select("shingle", *(F.col(x).alias(f"{x}_a") for x in ("class", "component", "loose"))).join(
        merged(side.select("shingle", *(F.col(x).alias(f"{x}_b") for x in ("class", "component", "loose")))), "shingle"
    ).where("class_a < class_b and component_a != component_b and (loose_a or loose_b)")
    links = _confirmed(met(pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()), sets, percent)

    crowded = sized.where(F.col("length") > small).select("shingle", "class", "component", "n")
    blocks = _main(crowded, "shingle").withColumn(
        "loose_blocks", F.ceil(F.greatest((F.col("length") - F.col("largest")) / block, F.col("loose_n") / BLOCK_SHINGLES)).cast("int")
    ).withColumn("all_blocks", F.ceil(F.greatest(F.col("length") / block, F.col("n") / BLOCK_SHINGLES)).cast("int"))
    crowded = crowded.drop("n").join(blocks.select("shingle", "main", "loose_blocks", "all_blocks"), "shingle")
    salted = F.xxhash64("class", "shingle")
    loose = crowded.where("component != main").select(
        "shingle", "class", "component", F.lit(0).alias("side"),
        F.pmod(salted, "loose_blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"),
    )
    every = crowded.select(
        "shingle", "class", "component", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("loose_blocks") - 1)).alias("i"), F.pmod(salted, "all_blocks").cast("int").alias("j"),
    )
    dealt = loose.union(every).join(merged(sets.join(merged(carried.select("class", "signature")), "class")), "class")
    more = dealt.groupBy("shingle", "i", "j").applyInPandas(_block_links(percent, matches), "a long, b long")
    return links.union(more)


def _main(listed: DataFrame, *keys: str) -> DataFrame:
    """The largest component of each list that has several, with classes (and shingles) of the list and outside it."""
    weighed = listed if "n" in listed.columns else listed.withColumn("n", F.lit(0))
    return (
        weighed.groupBy(*keys, "component")
        .agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
        .groupBy(*keys)
        .agg(
            F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("length"), F.max("size").alias("largest"),
            F.sum("n").alias("n"), F.max(F.struct("size", "component", "n")).alias("top"),
        )
        .where("largest < length")
        .withColumn("loose_n", F.col("n") - F.col("top.n"))
        .drop("top")
    )
