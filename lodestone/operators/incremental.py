"""What changed between two versions of a chunk table, and the table that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("source_file", "source_chunk_index", "chunk_index")
#: Rows of a range that is numbered, about; and ranges at most.
RANGE_ROWS, RANGES = 1 << 20, 1 << 17


def same(key: list[str] | tuple[str, ...], mark: str) -> list[Column]:
    """Join conditions between columns and those of the same names after ``mark``; null keys match."""
    return [F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in key]


def diff(old: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY, text: str = "text") -> DataFrame:
    """Keys with status: added, changed, unchanged or removed.  Keys must be distinct in each table; null keys match."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{name}_{k}") for k in key], F.md5(F.col(text)).alias(name), F.lit(True).alias(f"in_{name}"))

    on = [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in key]
    joined = side(old, "old").join(side(new, "new"), on, "full").select(*[F.coalesce(f"new_{k}", f"old_{k}").alias(k) for k in key], "old", "new", "in_old", "in_new")
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return joined.select(*key, status.alias("status"))


def count_up_to(bounds: Column, key: Column, most: int) -> Column:
    """How many of at most ``most`` sorted bounds are not over the key, by halving."""
    state = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        return F.when(s["low"] >= s["high"], s).when(F.get(bounds, middle) <= key, state(middle + 1, s["high"])).otherwise(state(s["low"], middle))

    steps = F.sequence(F.lit(1), F.lit(most.bit_length()))
    return F.aggregate(steps, state(F.lit(0), F.size(bounds)), halved)["low"]


def numbered(rows: DataFrame, order: list[str], start=0, name: str = "chunk_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Dense ids from ``start`` (a number or column) in the order of the columns, nulls first, without one task that sees all rows.

    Bounds taken from a sample of the keys cut the order into ranges of about ``range_rows`` rows.  Counts of the ranges, for which only
    the keys are read, are their offsets; within a range a window counts.  The bounds are fixed values, so all reads
    of ``rows`` agree on the ranges.  Rows with one key stand in the order of a hash of all their columns.
    """
    key = F.struct(*order)
    n = rows.select(*order).count()
    ranges = min(RANGES, -(-n // range_rows))
    part = F.lit(0)
    if ranges > 1:
        some = rows.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(max(1, n // (50 * ranges)))) == 0).distinct()
        cut = some.withColumn("r", F.ntile(ranges).over(Window.orderBy("k"))).groupBy("r").agg(F.min("k").alias("k")).where("r > 1")  # of about 50 keys for each range
        bounds = F.broadcast(cut.agg(F.sort_array(F.collect_list("k")).alias("__bounds")))
        rows = rows.join(bounds)
        part = count_up_to(F.col("__bounds"), key, ranges)
    rows = rows.withColumn("__part", part)
    counts = rows.groupBy("__part").count()
    ahead = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))  # a row for each range
    rows = rows.drop("__bounds")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])))
    return rows.withColumn("__n", place - 1).join(F.broadcast(ahead), F.col("__part") == F.col("__p")).withColumn(name, F.col("__n") + F.col("__ahead") + F.lit(start)).drop("__part", "__p", "__n", "__ahead")


def merge(old: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY, text: str = "text", id_col: str = "chunk_id", start: int | None = None) -> DataFrame:
    """The next version: unchanged rows keep their ids, added and changed ones get ids after the largest (or from ``start`` on), removed ones go.

    Rows to embed again are those with an id over the old maximum.  Null keys match.  All columns are those of ``new``.  Of old rows with one key that with the smallest
    id counts; of new rows with one key one keeps the id, one with an unchanged text if there is one, and the others are added.
    """
    columns = [c for c in new.columns if c != id_col]
    first = F.min(F.struct(F.col(id_col).alias("id"), F.md5(F.col(text)).alias("md5"))).alias("first")
    before = old.groupBy(*[F.col(k).alias(f"__old_{k}") for k in key]).agg(first).select(*[f"__old_{k}" for k in key], F.col("first.md5").alias("__md5"), F.col("first.id").alias("__id"))
    joined = new.select(*columns).join(before, same(key, "__old_"), "left").withColumn("__id", F.when(F.md5(F.col(text)).eqNullSafe(F.col("__md5")), F.col("__id")))
    again = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in columns])))
    kept = joined.where("__id IS NOT NULL").withColumn("__again", again)
    if start is None:
        start = old.agg(F.coalesce(F.max(id_col), F.lit(-1))).first()[0] + 1
    fresh = joined.where("__id IS NULL").select(*columns).unionByName(kept.where("__again > 1").select(*columns))
    return kept.where("__again = 1").select(F.col("__id").alias(id_col), *columns).unionByName(numbered(fresh, list(key), start, id_col).select(id_col, *columns))


def appended(old: DataFrame, new: DataFrame, id_col: str = "chunk_id", order: tuple[str, ...] = ("position",)) -> tuple[DataFrame, DataFrame]:
    """The compatible rule by (source_file, source_chunk_index): (changed new rows, old rows and those with new ids).

    Of old rows with one key the last text (by id) counts; stale and deleted rows stay.  Null keys match.  ``order``: of the new rows.
    """
    key = ["source_file", "source_chunk_index"]
    last_text = old.groupBy(*[F.col(k).alias(f"__old_{k}") for k in key]).agg(F.max_by("text", id_col).alias("__old"), F.lit(True).alias("__known"))
    changed = new.join(last_text, same(key, "__old_"), "left").where(F.col("__known").isNull() | ~F.col("text").eqNullSafe(F.col("__old"))).drop("__old", "__known", *[f"__old_{k}" for k in key])
    top = old.agg(F.coalesce(F.max(id_col), F.lit(-1))).first()[0]
    ids = numbered(changed.drop(id_col), list(order), top + 1, id_col)
    shared = [c for c in old.columns if c in ids.columns]
    return changed, old.select(*shared).unionByName(ids.select(*shared))
