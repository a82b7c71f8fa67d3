"""Places in an order, and lists in pages, without a task that holds a whole large group.

Rows are sorted by ranges of (group, order), so that a group of any size lies in neighbouring partitions; each partition numbers its own rows, and one
count for each group and partition tells by how much. The sorted rows are written first, so that numbers stay whatever is run again.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written

PAGE = 100

#: Rows of a list from which on it is put in order by many tasks.
LONG = 100_000

#: Rows of a list that long which a sample is expected to hold; a list with half as many counts as long.
SAMPLED = 200

#: Rows that a task puts in order, on average: some 100 MB, so that no sort is spilled.
TASK_ROWS = 500_000


def _same(a: DataFrame, b: DataFrame, names: dict[str, str]) -> Column:
    return reduce(Column.__and__, (a[x].eqNullSafe(b[y]) for x, y in names.items()))


def ranked(rows: DataFrame, by: list[str], order: list[str], place: str = "place", size: str = "size") -> DataFrame:
    """rows, with each one's place (from 0) among those of its group in ascending order, and the group's size. Nulls form a group and come first
    in an order; equal rows are placed one after the other. With no `by`, all rows are one group."""
    keys = [*by, *order]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a row for each partition that a group is in
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if by:
        counts = counts.select(*(F.col(b).alias(f"_{b}") for b in by), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(*by)).alias("_size"))
    else:
        # one number for each task comes to the driver, which knows the tasks anyhow
        known, total, shifts = sorted(tuple(r) for r in counts.collect()), 0, []
        for part, first, n in known:
            shifts.append((part, total - first))
            total += n
        counts = F.broadcast(rows.sparkSession.createDataFrame([(*s, total) for s in shifts], "_p int, _shift bigint, _size bigint"))
    at = placed.join(counts, _same(placed, counts, {**{b: f"_{b}" for b in by}, "_part": "_p"}))
    return at.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(place), F.col("_size").alias(size))


def _long(rows: DataFrame, by: list[str], long: int, shown: dict[str, Column]) -> tuple[DataFrame, float]:
    """The groups that a sample finds long, and about how many rows there are. It only chooses how a group is put in order: any choice gives the same
    pages. Of n rows, no more than some 2 n / long groups are found. What the sample holds is written down once."""
    share = min(1.0, SAMPLED / long)
    seen = (rows if share >= 1 else rows.sample(share, seed=1)).withColumns(shown)
    counts = written(seen.groupBy(*by).agg(F.count("*").alias("n")))
    hubs = counts.filter(F.col("n") >= share * long / 2).select(*(F.col(b).alias(f"_{b}") for b in by))
    return hubs, (counts.agg(F.sum("n")).first()[0] or 0) / share


def _short_pages(rows: DataFrame, by: list[str], order: list[str], fields: list[str], per_page: int, once: bool, shown: dict[str, Column], near: list[str], size: float) -> DataFrame:
    """Pages of lists each of which one task can put in order: one shuffle and one sort for everything."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, ceil(size / TASK_ROWS))
    rows = rows.repartition(parts, *near).withColumns(shown).select(*dict.fromkeys([*near, *by, *order, *fields]))
    # what the order leaves open is settled by the other columns, so that repeats lie together and all windows share the sort
    within = Window.partitionBy(*dict.fromkeys([*near, *by])).orderBy(*dict.fromkeys([*order, *fields]))
    if once:
        own = F.struct(*dict.fromkeys([*order, *fields]))
        rows = rows.withColumns({"_before": F.lag(own).over(within), "_own": own}).filter(~F.col("_before").eqNullSafe(F.col("_own"))).drop("_before", "_own")
    whole, page = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), within.rowsBetween(0, per_page - 1)
    at = rows.select(
        *by, (F.row_number().over(within) - 1).cast("long").alias("place"), F.count("*").over(whole).alias("size"),
        F.collect_list(F.struct(*fields)).over(page).alias("entries"), F.lead(F.struct(*order), per_page).over(within).alias("next"),
    )
    heads = at.filter(F.col("place") % per_page == 0)
    return heads.select(*by, F.floor(F.col("place") / per_page).alias("page"), F.ceil(F.col("size") / per_page).alias("pages"), "size", "entries", "next")


def paged(rows: DataFrame, by: list[str], order: list[str], fields: list[str], per_page: int = PAGE, *, once: bool = False, long: int = LONG, shown: dict[str, Column] | None = None, near: list[str] | None = None) -> DataFrame:
    """by, page, pages, size, entries (structs of the fields, at most per_page), next: every list in pages, however long.

    next holds the order's values of the entry that the page after this one begins with, and is null on the last page: a reader that has a
    page asks for the next by it. Each page is gathered by itself, so a hub is many rows and no row grows with it. once: rows that repeat in all
    columns count once. Lists of about `long` rows or more are ranked by many tasks, the others put in order where one shuffle brings them.

    shown: columns named in by, order or fields that the rows don't have, as what the rows' own columns give. They are computed after the shuffle,
    so that only the rows' own columns are moved. near: columns of the rows in which all rows of a list agree, and by which they are brought together;
    by default those of `by`.
    """
    shown, near = shown or {}, near or by
    rows = rows if shown else rows.select(*dict.fromkeys([*by, *order, *fields]))
    hubs, size = _long(rows, by, long, shown)
    if hubs.isEmpty():
        return _short_pages(rows, by, order, fields, per_page, once, shown, near, size)
    named = rows.withColumns(shown)
    same = _same(named, hubs, {b: f"_{b}" for b in by})
    own = named.join(F.broadcast(hubs), same, "left_semi").select(*dict.fromkeys([*by, *order, *fields]))
    if once:
        own = own.repartition(*own.columns).distinct()
    short = named.join(F.broadcast(hubs), same, "left_anti").select(*rows.columns)
    return _short_pages(short, by, order, fields, per_page, once, shown, near, size).unionByName(_long_pages(own, by, order, fields, per_page))


def _long_pages(rows: DataFrame, by: list[str], order: list[str], fields: list[str], per_page: int) -> DataFrame:
    """Pages of lists that many tasks rank together."""
    at = ranked(rows, by, order)
    page = F.floor(F.col("place") / per_page)
    entry = F.struct(F.col("place"), F.struct(*fields).alias("entry"))
    # the first entry of a page is also the continuation of the page before
    key = F.struct(*order)
    shown = at.select(*by, page.alias("page"), "size", entry.alias("entry"), F.lit(None).cast(rows.select(key).schema[0].dataType).alias("next"))
    heads = at.filter((F.col("place") > 0) & (F.col("place") % per_page == 0)).select(*by, (page - 1).alias("page"), "size", F.lit(None).cast(shown.schema["entry"].dataType).alias("entry"), key.alias("next"))
    done = shown.unionByName(heads).groupBy(*by, "page", "size").agg(F.array_sort(F.collect_list("entry")).alias("entries"), F.max("next").alias("next"))
    return done.select(*by, "page", F.ceil(F.col("size") / per_page).alias("pages"), "size", F.transform("entries", lambda e: e["entry"]).alias("entries"), "next")
