"""Facets as bitmaps: any choice of values in any facets is a few unions and intersections of bits, and no record is read again.

Records are numbered densely, and each value of a facet has a bitmap for every 32,768 numbers among which it occurs, 4 kB each: what a third of all
records have is as many rows as what few of them have in as many places. Facets are for values that many records share; a column of mostly
different values costs as many bitmaps as it has values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import written
from .ranks import ranked

ALL = "*"


def bit(mask: Column, position: Column) -> Column:
    """Whether a bitmap has a bit."""
    byte = F.conv(F.hex(F.substring(mask, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


class FacetIndex:
    """members: id, bucket, position; sets: facet, value, bucket, bits, and under the facet ALL those of all records. Both are written tables."""

    def __init__(self, members: DataFrame, sets: DataFrame, facets: list[str]):
        self.members, self.sets, self.facets = members, sets, facets

    @classmethod
    def build(cls, rows: DataFrame, facets: list[str], id: str = "id") -> FacetIndex:
        """facets: columns, or array columns, of whose elements a record has each. A null value, or an empty array, is in no set. Ids are distinct."""
        arrays = {f for f in facets if rows.schema[f].dataType.typeName() == "array"}
        of = lambda f: F.array_distinct(F.col(f).cast("array<string>")) if f in arrays else F.array(F.col(f).cast("string"))
        named = lambda f: lambda v: F.struct(F.lit(f).alias("facet"), v.alias("value"))
        values = F.flatten(F.array(*(F.transform(F.coalesce(of(f), F.array().cast("array<string>")), named(f)) for f in facets), F.array(named(ALL)(F.lit("")))))
        at = ranked(rows.select(F.col(id).alias("id"), values.alias("values")), [], ["id"], "n", "size")
        n = F.col("n") + 1
        at = written(at.select("id", F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("position"), "values"))
        each = at.select("bucket", "position", F.explode("values").alias("v")).select("v.*", "bucket", "position").filter("value IS NOT NULL")
        sets = written(each.groupBy("facet", "value", "bucket").agg(F.bitmap_construct_agg("position").alias("bits")))
        return cls(at.select("id", "bucket", "position"), sets, facets)

    def set_of(self, ids: DataFrame) -> DataFrame:
        """bucket, bits of any ids, as of a search."""
        return self.members.join(ids.select("id").distinct(), "id", "left_semi").groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits"))

    def _masks(self, chosen: dict[str, list[str]], within: DataFrame | None) -> DataFrame:
        """key, bucket, mask: what all choices leave (key ALL), and for each chosen facet what those in the others leave."""
        base = self.sets.filter(F.col("facet") == ALL).select("bucket", "bits") if within is None else self.set_of(within)
        keys = [ALL, *chosen]
        parts = [base.withColumn("keys", F.array(*map(F.lit, keys)))]
        for f, values in chosen.items():
            union = self.sets.filter((F.col("facet") == f) & F.col("value").isin(values)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            parts.append(union.withColumn("keys", F.array(*(F.lit(k) for k in keys if k != f))))
        met = reduce(DataFrame.unionByName, parts).select(F.explode("keys").alias("key"), "bucket", "bits")
        # a bucket that a choice has no bits in has none in common
        whole = F.when(F.col("key") == ALL, len(chosen) + 1).otherwise(len(chosen))
        return met.groupBy("key", "bucket").agg(F.bitmap_and_agg("bits").alias("mask"), F.count("*").alias("n")).filter(F.col("n") == whole).drop("n")

    def counts(self, chosen: dict[str, list[str]] | None = None, within: DataFrame | None = None) -> DataFrame:
        """facet, value, total, n, chosen of every value: n counts the records that the choices in all other facets leave, as a list of values shows
        them where several can be chosen. chosen: values by facet, any of which a record may have; a facet without values isn't
        chosen. within: ids of a search."""
        picked = {f: list(v) for f, v in (chosen or {}).items() if v}
        if unknown := set(picked) - set(self.facets):
            raise ValueError(f"No such facet: {sorted(unknown)[0]}")
        own = self.sets.filter(F.col("facet") != ALL)
        key = F.when(F.col("facet").isin(list(picked)), F.col("facet")).otherwise(ALL) if picked else F.lit(ALL)
        met = own.withColumn("key", key).join(self._masks(picked, within), ["key", "bucket"]).select("facet", "value", "bucket", F.explode(F.array("bits", "mask")).alias("bits"))
        both = met.groupBy("facet", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n")).groupBy("facet", "value").agg(F.sum("n").alias("n"))
        total = own.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).alias("total"))
        is_chosen = reduce(Column.__or__, ((F.col("facet") == f) & F.col("value").isin(v) for f, v in picked.items()), F.lit(False))
        return total.join(both, ["facet", "value"], "left").select("facet", "value", "total", F.coalesce("n", F.lit(0)).alias("n"), is_chosen.alias("chosen"))

    def ids(self, chosen: dict[str, list[str]] | None = None, within: DataFrame | None = None) -> DataFrame:
        """id of the records that all choices leave."""
        picked = {f: list(v) for f, v in (chosen or {}).items() if v}
        mask = self._masks(picked, within).filter(F.col("key") == ALL).select("bucket", "mask")
        return self.members.join(mask, "bucket").filter(bit(F.col("mask"), F.col("position"))).select("id")
