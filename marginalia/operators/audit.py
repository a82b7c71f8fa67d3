"""Audit of built pages: links, required routes, counters with thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Links that leave the site, routes that must exist, and the least numbers of pages.
EXTERNAL = r"^(https?:|mailto:|data:|tel:)"
ROUTES = ("index.html", "graph/index.html", "index/index.html", "timeline/index.html", "imports/index.html", "404.html")
LEAST_NODE_PAGES, LEAST_MATH_PAGES = 25, 10
RENDER_ERROR, RENDERED = "katex-error", 'class="katex"'


def links(pages: DataFrame, id: str, html: str) -> DataFrame:
    """id, attr, raw, target of each link or asset inside the site; target: decoded, without query."""
    pattern = F.lit(r'\b(?:href|src)="[^"#]+"')
    each = pages.select(F.col(id), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), pattern, F.lit(0))).alias("a"))
    each = each.select(id, F.regexp_extract("a", r"^(href|src)", 1).alias("attr"), F.regexp_extract("a", r'"([^"#]+)"', 1).alias("raw"))
    path = F.regexp_extract("raw", r"^[^?]*", 0)
    target = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return each.filter(~F.col("raw").rlike(EXTERNAL)).withColumn("target", target).filter("target <> ''")


def resolve(target: Column, page_dir: Column, base: str) -> Column:
    """Path below the site's root: absolute targets lose the base, relative ones go on from the page's folder."""
    joined = F.when(target.startswith("/"), F.substr(target, F.lit(len(base) + 1))).otherwise(F.concat_ws("/", F.when(page_dir != "", page_dir), target))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.array_join(folded, "/")


def link_errors(found: DataFrame, id: str, base: str, known: DataFrame, page_dir: Column | None = None) -> DataFrame:
    """id, attr, raw, problem: `missing base path` of absolute targets outside the base, `broken` of those that no known path answers.

    known: (path), of files and of folders that have an index.
    """
    absolute = F.col("target").startswith("/")
    off = found.filter(absolute & ~F.col("target").startswith(base)).select(id, "attr", "raw", F.lit("missing base path").alias("problem"))
    inside = found.filter(~absolute | F.col("target").startswith(base)).withColumn("path", resolve(F.col("target"), page_dir if page_dir is not None else F.lit(""), base))
    broken = inside.join(known.select("path").distinct(), "path", "left_anti").select(id, "attr", "raw", F.lit("broken").alias("problem"))
    return off.unionByName(broken)


def missing_routes(known: DataFrame, routes: tuple[str, ...] = ROUTES) -> DataFrame:
    wanted = known.sparkSession.createDataFrame([(r,) for r in routes], "path string")
    return wanted.join(known.select("path"), "path", "left_anti")


def counters(pages: DataFrame, path: str, html: str) -> DataFrame:
    """pages, node_pages, math_pages, render_errors, and whether the thresholds hold; one pass."""
    text = F.coalesce(F.col(html), F.lit(""))
    n = pages.agg(F.count("*").alias("pages"), F.count_if(F.contains(F.col(path), F.lit("/node/"))).alias("node_pages"), F.count_if(text.contains(RENDERED)).alias("math_pages"), F.count_if(text.contains(RENDER_ERROR)).alias("render_errors"))
    return n.withColumns({"enough_nodes": F.col("node_pages") >= LEAST_NODE_PAGES, "enough_math": F.col("math_pages") >= LEAST_MATH_PAGES})
