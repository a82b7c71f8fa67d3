"""Search and facets over node records."""

from __future__ import annotations

from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .trigrams import TrigramIndex


def haystack(*columns: str | Column) -> Column:
    """What a query is looked for in: the columns in lower case, nulls as empty."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns)))


def matches(query: str, where: Column) -> Column:
    """A substring, white space around the query aside; an empty query matches all."""
    return where.contains(query.strip().lower())


def facets(**wanted) -> Column:
    """All facets that are set must hold; a facet over an array column holds if the value is a member."""
    cond = F.lit(True)
    for name, value in wanted.items():
        if value not in (None, ""):
            cond = cond & (F.array_contains(F.col(name[:-8]), value) if name.endswith("__member") else F.coalesce(F.col(name) == value, F.lit(False)))
    return cond


def graph_filter(nodes: DataFrame, query: str = "", type: str = "", standing: str = "", editorial: str = "", project: str = "", publication: str = "") -> DataFrame:
    where = haystack("id", "title", "shortTitle", "summary", F.array_join("tags", " "))
    return nodes.filter(facets(type=type, claimStanding=standing, editorialState=editorial, projects__member=project, publicationStatus=publication) & matches(query, where))


def index_filter(nodes: DataFrame, query: str = "", standing: str = "", editorial: str = "", project: str = "", publication: str = "") -> DataFrame:
    """As graph_filter, but without the type, and not looking into short titles."""
    where = haystack("id", "title", "summary", F.array_join("tags", " "))
    return nodes.filter(facets(claimStanding=standing, editorialState=editorial, projects__member=project, publicationStatus=publication) & matches(query, where))


def indexed_filter(nodes: DataFrame, index: TrigramIndex, query: str = "", **wanted: str) -> DataFrame:
    """What the filters above show, with an index over the same haystack in place of the scan; wanted: as for `facets`."""
    shown = nodes.filter(facets(**wanted))
    return shown.join(index.search(query), "id", "left_semi") if query.strip() else shown


def view_state(address: str, projects: list[str], nodes: DataFrame | None = None) -> dict[str, str]:
    """What an address asks of a view, as far as it is valid: a project that exists, and a node that does. Anything else in it is ignored."""
    asked = {k: v[0] for k, v in parse_qs(urlsplit(address).query).items()}
    state = {"project": asked["project"]} if asked.get("project") in projects else {}
    if "node" in asked and (nodes is None or not nodes.filter(F.col("id") == asked["node"]).isEmpty()):
        state["node"] = asked["node"]
    return state


def bucket_counts(nodes: DataFrame, shown: DataFrame, column: str, sections: tuple = S.INDEX_SECTIONS) -> DataFrame:
    """section, total, visible of the index's sections in order; empty ones have zeros and hidden = true."""
    spark = nodes.sparkSession
    dim = F.broadcast(spark.createDataFrame([(i, t, v) for i, (t, vs) in enumerate(sections) for v in vs], "pos int, section string, value string"))  # fixed, a row for each type
    count = lambda df, name: df.join(dim, df[column] == dim["value"]).groupBy("section").agg(F.count("*").alias(name))
    names = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(sections)], "pos int, section string")
    out = names.join(count(nodes, "total"), "section", "left").join(count(shown, "visible"), "section", "left").fillna(0, ["total", "visible"])
    return out.withColumn("hidden", F.col("visible") == 0)


def result_message(total: int, shown: int) -> str:
    return f"{shown} of {total} objects shown" if shown else "No objects match. Try another search or reset the filters."


def status_cube(nodes: DataFrame, *axes: str) -> DataFrame:
    """Counts over every combination of independent axes; a null stands for all values of an axis."""
    return nodes.cube(*axes).agg(F.count("*").alias("n"))
