"""Column functions shared by the operators; all of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Letters and digits of any script and the underscore; Java's ``\\w`` would be ASCII only.
WORD = r"[\p{L}\p{N}_]+"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def tokens(text: Column) -> Column:
    """Lower-case word tokens; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def joined_text(*parts: Column) -> Column:
    """Parts joined by single spaces, nulls as empty, white space stripped at both ends."""
    filled = [F.coalesce(p, F.lit("")) for p in parts]
    out = filled[0]
    for part in filled[1:]:
        out = F.concat(out, F.lit(" "), part)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def last_n(array: Column, n: int) -> Column:
    """The last ``n`` elements of an array (all of a shorter one)."""
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), F.lit(n))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used and in whatever lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def normalised(vector: Column) -> Column:
    """The vector divided by its Euclidean norm; a zero vector is left as it is."""

    def divided(v: Column) -> Column:
        return held(F.sqrt(dot(v, v)), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(
            F.transform(v, lambda x: x.cast("double"))
        ))

    return held(vector, divided)


def few(table: DataFrame, rows: int = 10_000) -> DataFrame:
    """The table marked for broadcast; the query fails where it has more than ``rows`` rows, so the size is proven."""
    counted = table.limit(rows + 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    held = F.when(F.col("_n") <= rows, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"a table to broadcast has more than {rows} rows")).cast("boolean")
    )
    return F.broadcast(counted.where(held).drop("_n"))


def mebibytes(size: Column) -> Column:
    """Bytes as MiB."""
    return size / (1024.0 * 1024.0)
