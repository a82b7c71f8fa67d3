"""Nodes and relations as a graph. Edges are derived, never stored.

relations: (id, target, type, note, pos), the explicit ones; depends: (id, target, pos); about: (id, target).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import Rounds
from .ranks import ranked

DEPENDS = "depends-on"


def relations_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """relations, depends and about of nested node records."""
    r = nodes.select("id", F.posexplode("relations").alias("pos", "r")).select("id", "r.target", "r.type", "r.note", "pos")
    d = nodes.select("id", F.posexplode("dependsOn").alias("pos", "target"))
    a = nodes.select("id", F.posexplode("about").alias("pos", "target"))
    return r, d, a


def every_relation(relations: DataFrame, depends: DataFrame) -> DataFrame:
    """id, target, type, pos, note: all that is said, dependencies behind the explicit relations."""
    explicit = relations.select("id", "target", "type", F.col("pos").cast("long").alias("pos"), "note")
    implied = depends.select("id", "target", F.lit(DEPENDS).alias("type"), (F.col("pos") + F.lit(1 << 32)).alias("pos"), F.lit(None).cast("string").alias("note"))
    return explicit.unionByName(implied)


def first_of(every: DataFrame) -> DataFrame:
    """Of the relations that repeat a target and type, the first. Minima, not a window: the place is a number, which is hashed in generated code,
    and the note an aggregate of its own, which isn't computed where nobody asks for it. Few relations repeat, so they are shuffled as they are:
    combining them first would hold nearly all rows of a task. What drops rows by id, target or type gives the same before as after."""
    return every.repartition("id", "target", "type").groupBy("id", "target", "type").agg(F.min_by("note", F.struct("pos", "note")).alias("note"), F.min("pos").alias("pos"))


def normalized_relations(relations: DataFrame, depends: DataFrame) -> DataFrame:
    """Explicit relations first, then dependencies; of those that repeat a target and type, the first."""
    return first_of(every_relation(relations, depends))


def edge_id(source: Column, type: Column, target: Column) -> Column:
    return F.concat(source, F.lit(":"), type, F.lit(":"), target)


def pointing(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose target is among the ids, or, by left_anti, isn't. Repeated ids change nothing."""
    return rows.join(ids.select(F.col("id").alias("target")), "target", how).select(*rows.columns)


def semantic_edges(relations: DataFrame, ids: DataFrame | None) -> DataFrame:
    """edge_id, source, target, type, kind, note of normalised relations whose target is a node; ids: None if that is known."""
    known = relations if ids is None else pointing(relations, ids)
    return known.select(edge_id(F.col("id"), F.col("type"), F.col("target")).alias("edge_id"), F.col("id").alias("source"), "target", "type", F.lit("semantic").alias("kind"), "note")


def about_edges(about: DataFrame, ids: DataFrame) -> DataFrame:
    """Structural edges; unknown targets are dropped, repeats are not."""
    known = pointing(about, ids)
    kind = F.lit("about")
    return known.select(edge_id(F.col("id"), kind, F.col("target")).alias("edge_id"), F.col("id").alias("source"), "target", kind.alias("type"), F.lit("structural").alias("kind"), F.lit(None).cast("string").alias("note"))


def all_edges(relations: DataFrame, about: DataFrame, ids: DataFrame) -> DataFrame:
    return semantic_edges(relations, ids).unionByName(about_edges(about, ids))


def edges_of_all(every: DataFrame, about: DataFrame, ids: DataFrame) -> DataFrame:
    """The same edges from relations that aren't normalised yet: those that lead nowhere go first."""
    return semantic_edges(first_of(pointing(every, ids)), None).unionByName(about_edges(about, ids))


def graph_nodes(nodes: DataFrame, base: str = "/") -> DataFrame:
    """Nodes as a graph shows them: without sources, with their address."""
    from ..functions.text import node_url

    return nodes.drop("sources").withColumn("href", node_url(F.lit(base), F.col("id")))


def dangling(relations: DataFrame, ids: DataFrame) -> DataFrame:
    return pointing(relations, ids, "left_anti").select("id", "target", "type")


def incoming(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("target").alias("id"), F.col("id").alias("source"), "type")


def listed(type: Column, incoming: bool) -> tuple[Column, Column]:
    """The bucket and the label under which a node's page lists a relation that it has, or that leads to it.

    An incoming relation stays under related unless it is a dependency or an example, so an incoming `uses` shows there too.
    """
    if incoming:
        label = F.when(type == DEPENDS, "depends on this object").when(type == "example-of", type).otherwise(F.concat(type, F.lit(" → this object")))
        return F.when(type == DEPENDS, "consequences").when(type == "example-of", "examples").otherwise("related"), label
    return F.when(type.isin(DEPENDS, "uses"), "dependencies").when(type.isin("implies", "motivates"), "consequences").otherwise("related"), type


def buckets(relations: DataFrame) -> DataFrame:
    """id, bucket, other, label: what a node's page lists, all four buckets from one pass over the edges."""
    (out, own), (back, label) = (listed(F.col("type"), x) for x in (False, True))
    row = lambda id, bucket, other, label: F.struct(F.col(id).alias("id"), bucket.alias("bucket"), F.col(other).alias("other"), label.alias("label"))
    return relations.select(F.explode(F.array(row("id", out, "target", own), row("target", back, "id", label))).alias("r")).select("r.*")


def touching(edges: DataFrame, centre: str | None = None) -> DataFrame:
    """id, other, type, direction of the edges at each node, or at one."""
    if centre is not None:  # here the planner can take the condition down to the tables
        edges = edges.filter((F.col("source") == centre) | (F.col("target") == centre))
    both = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other"), "type", F.lit("out").alias("direction")), F.struct(F.col("target").alias("id"), F.col("source").alias("other"), "type", F.lit("in").alias("direction")))).alias("e")).select("e.*")
    return both.filter(F.col("id") == centre) if centre is not None else both


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """id, neighbours; edges: source, target, in which repeats count once."""
    ends = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("other"))
    pairs = edges.select(F.explode(F.array(ends("source", "target"), ends("target", "source"))).alias("e")).select("e.*").repartition("id", "other").distinct()
    return pairs.groupBy("id").agg(F.count("*").alias("neighbours"))


def links(relations: DataFrame, depends: DataFrame, about: DataFrame, ids: DataFrame) -> DataFrame:
    """source, target of everything that leads to a node, as often as it is said: for what only asks which nodes are joined, which normalising
    the relations first doesn't change."""
    every = relations.select(F.col("id").alias("source"), "target").unionByName(depends.select(F.col("id").alias("source"), "target")).unionByName(about.select(F.col("id").alias("source"), "target"))
    return pointing(every, ids).select("source", "target")


def neighbourhood(edges: DataFrame, centre: str) -> DataFrame:
    """The edges among a node and its direct neighbours."""
    at = edges.filter((F.col("source") == centre) | (F.col("target") == centre))
    ids = at.select(F.explode(F.array("source", "target", F.lit(centre))).alias("n")).distinct()
    return induced(edges, ids.withColumnRenamed("n", "id"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the ids."""
    ids = ids.select("id")
    one = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return one.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def contained(papers: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """id, member: what appears in a paper, or shares a source key with it. Two equi joins and a union in place of a join with OR.

    papers: (id, source_key); members: (id, source_key).
    """
    by_relation = relations.filter("type = 'appears-in'").join(papers.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select(F.col("target").alias("id"), F.col("id").alias("member"))
    by_source = papers.join(members.withColumnRenamed("id", "member"), "source_key").select("id", "member")
    return by_relation.unionByName(by_source).filter("id <> member").distinct()


def highlighted(edges: DataFrame, centre: str) -> DataFrame:
    """What selecting a node lights up: kind node, the closed neighbourhood, and kind edge, the edges at the node. Columns kind, id."""
    at = touching(edges, centre)
    around = at.select(F.explode(F.array("id", "other")).alias("id")).unionByName(edges.sparkSession.createDataFrame([(centre,)], "id string")).distinct()
    own = edges.filter((F.col("source") == centre) | (F.col("target") == centre)).select(edge_id(F.col("source"), F.col("type"), F.col("target")).alias("id"))
    return around.select(F.lit("node").alias("kind"), "id").unionByName(own.select(F.lit("edge").alias("kind"), "id"))


def claims_about(about: DataFrame, claims: DataFrame) -> DataFrame:
    """id, claim and the other columns of claims (id, ...): for each node the claims that say they are about it."""
    known = claims.withColumnRenamed("id", "claim")
    return about.select(F.col("id").alias("claim"), F.col("target").alias("id")).join(known, "claim").select("id", *known.columns)


def member_titles(members: DataFrame, registry: DataFrame, sign: str = " · ") -> DataFrame:
    """id, titles: the titles of what each node is a member of, in the order in which it lists them; unknown keys are left out.

    members: id, pos, key, of which a node has a few; registry: key, title.
    """
    named = members.join(registry.select("key", "title"), "key")
    return named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]), sign).alias("titles"))


def group_tone(first_group: Column, groups: list[str], tones: int = 3) -> Column:
    """The tone of a node by its first group's place among the groups, over and over; -1 without a known group."""
    at = F.array_position(F.array(*map(F.lit, groups)), first_group) - 1 if groups else F.lit(-1)
    return F.when(F.coalesce(at, F.lit(-1)) < 0, F.lit(-1)).otherwise(at % tones).cast("int")


def closure(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """id, ancestor, depth: everything each node reaches, at its least depth, however deep.

    What is known up to depth h is doubled: pairs exactly h apart go on by all that is known, which gives all pairs up to 2h, as a shortest
    path has a node h steps from its start. So the rounds grow with the logarithm of the depth. Circles are no harm. Each round's pairs,
    no more than the result has, are written to the shared folder.
    """
    pairs = edges.select(F.col(source).alias("id"), F.col(target).alias("ancestor")).filter("id IS NOT NULL AND ancestor IS NOT NULL")
    with Rounds(edges.sparkSession) as rounds:
        found = rounds.cut(pairs.distinct().withColumn("depth", F.lit(1)))
        depth = 1
        while True:
            on = found.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
            far = found.filter(F.col("depth") == depth).join(on, "ancestor").groupBy("id", F.col("next").alias("ancestor")).agg((F.min("more") + depth).alias("depth"))
            new = rounds.cut(far.join(found, ["id", "ancestor"], "left_anti"))
            if new.isEmpty():
                return rounds.keep(found)
            found, depth = found.unionByName(new.select(*found.columns)), 2 * depth


def ring(members: DataFrame, group: str, id: str, groups: list[str] | None = None) -> DataFrame:
    """x, y of each member on its group's ring, the groups three in a row; a node with several groups is placed by its first.

    group: a column, or an array column, whose first element counts. groups: their order; by default they are sorted. Members without a group, or
    with one not among the groups, aren't drawn. Places are found by `ranked`, so a ring of any size is numbered by all tasks.
    """
    if members.schema[group].dataType.typeName() == "array":
        members = members.withColumn(group, F.get(group, F.lit(0)))
    if groups is None:
        known = ranked(members.select(F.col(group).alias("_group")).filter("_group IS NOT NULL").distinct(), [], ["_group"], "g", "gs").drop("gs")
    else:
        known = members.sparkSession.createDataFrame([(n, g) for g, n in enumerate(dict.fromkeys(groups))], "_group string, g bigint")
    at = ranked(members.join(known, F.col(group) == F.col("_group")).drop("_group"), [group], [id], "i", "n")
    angle = F.col("i") / F.col("n") * (2 * F.pi()) - F.pi() / 2
    r = F.greatest(F.lit(200.0), F.least(F.lit(250.0), F.col("n") * 13.0))
    return at.withColumns({"x": 260 + F.pmod("g", F.lit(3)) * 550 + F.cos(angle) * r, "y": 300 + F.floor(F.col("g") / 3) * 570 + F.sin(angle) * r * 0.85}).drop("i", "n", "g")


def compact_ring(members: DataFrame, centre: str, id: str = "id") -> DataFrame:
    """x, y of a neighbourhood: the centre in the middle, the others around it in order, however many they are."""
    rest = ranked(members.filter(F.col(id) != centre), [], [id], "i", "n")
    angle = F.col("i") / F.col("n") * (2 * F.pi())
    around = rest.select(*members.columns, (260 + 215 * F.cos(angle)).alias("x"), (210 + 165 * F.sin(angle)).alias("y"))
    return around.unionByName(members.filter(F.col(id) == centre).withColumns({"x": F.lit(260.0), "y": F.lit(210.0)}))


def timeline(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """stage, id, label, motivates (sorted titles) of the nodes that have a stage."""
    staged = nodes.filter("stage IS NOT NULL").select("id", "label", "stage")
    titles = nodes.select(F.col("id").alias("target"), F.col("label").alias("other"))
    links = relations.filter("type = 'motivates'").join(titles, "target").groupBy("id").agg(F.sort_array(F.collect_list("other")).alias("motivates"))
    return staged.join(links, "id", "left").select("stage", "id", "label", F.coalesce("motivates", F.array().cast("array<string>")).alias("motivates"))
