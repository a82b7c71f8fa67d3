"""Circles in a directed graph: its strongly connected components, and one circle in each as a witness.

Edges are trimmed first: what nothing leads to, and what leads nowhere, is in no circle. Nodes with one way in and one way out are taken out of
the chains they are in, whose length falls by a constant share a turn. What is left is coloured: each node takes the least node that reaches it,
by steps along the edges and by jumps from colour to colour. Nodes of one circle have one colour; the node that a colour is named after, and what
reaches it within the colour, is a component. It goes, as do edges between colours, and the rest is trimmed and coloured again.

Every round is joins and combined minima, written to the shared checkpoint folder; nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import Rounds


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges (u, v) without those that nothing leads to or that lead nowhere: one step."""
    kept = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return kept.join(kept.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v")


def _links(edges: DataFrame, turn: int, rounds: Rounds) -> DataFrame:
    """x, before, after: nodes with one way in and one way out, no two neighbours among them; of neighbours in a chain, the one whose hash of this
    turn is least."""
    ways = edges.groupBy(F.col("v").alias("x")).agg(F.count("*").alias("ways"), F.first("u").alias("before"))
    ways = ways.join(edges.groupBy(F.col("u").alias("x")).agg(F.count("*").alias("out"), F.first("v").alias("after")), "x").filter("ways = 1 AND out = 1 AND before <> x").select("x", "before", "after")
    ways = rounds.cut(ways)
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c))
    near = lambda c: ways.join(ways.select(F.col("x").alias(c)), c, "left_semi").filter(rank(c) < rank("x")).select("x")
    return rounds.cut(ways.join(near("before").unionByName(near("after")).distinct(), "x", "left_anti"))


def reduced(edges: DataFrame, rounds: Rounds) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (u, v) that no trimming removes, with the chains in them shortened, and the links taken out, turn by turn.

    While a trimming step halves the edges, it is all that a turn does; so the turns grow with the logarithm of the edges.
    """
    left, taken, turn = rounds.cut(edges), [], 0
    n = left.count()
    while n:
        turn += 1
        kept = rounds.cut(_trimmed(left))
        before, n, left = n, kept.count(), kept
        if not n or n <= before // 2:
            continue
        chosen = _links(kept, turn, rounds)
        if chosen.isEmpty():
            if n == before:
                break
            continue
        taken.append(chosen)
        gone = chosen.select("x")
        rest = kept.join(gone.withColumnRenamed("x", "u"), "u", "left_anti").join(gone.withColumnRenamed("x", "v"), "v", "left_anti").select("u", "v")
        left = rounds.cut(rest.unionByName(chosen.select(F.col("before").alias("u"), F.col("after").alias("v"))).distinct())
        n = left.count()
    return left, taken


def _coloured(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """id, colour: the least node that reaches each node, itself included."""
    now = rounds.cut(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("colour", F.col("id")))
    while True:
        told = edges.join(now.withColumnRenamed("id", "u"), "u").select(F.col("v").alias("id"), "colour")
        step = now.withColumn("old", F.col("colour")).unionByName(told.withColumn("old", F.lit(None).cast(now.schema["colour"].dataType)))
        step = step.groupBy("id").agg(F.min("colour").alias("colour"), F.max("old").alias("old"))
        # what reaches the node that a colour is named after also reaches the colour
        further = now.filter("colour < id").select(F.col("id").alias("colour"), F.col("colour").alias("least"))
        new = rounds.cut(step.join(further, "colour", "left").select("id", F.least("colour", "least").alias("colour"), "old"))
        now = new.select("id", "colour")
        if new.filter("colour < old").isEmpty():
            return now


def _split(edges: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """(id, component) of the components that colours are named after, as far as they are circles, and the edges left for further rounds."""
    colours = _coloured(edges, rounds)
    within = edges.join(colours.withColumnRenamed("id", "u").withColumnRenamed("colour", "cu"), "u").join(colours.withColumnRenamed("id", "v").withColumnRenamed("colour", "cv"), "v")
    within = rounds.cut(within.filter("cu = cv").select("u", "v", F.col("cu").alias("colour")))
    # backwards from the nodes that colours are named after, all colours at once
    members = newest = rounds.cut(colours.filter("id = colour"))
    while not newest.isEmpty():
        newest = within.join(newest.select(F.col("id").alias("v")), "v", "left_semi").select(F.col("u").alias("id"), "colour").distinct()
        newest = rounds.cut(newest.join(members.select("id"), "id", "left_anti"))
        members = members.unionByName(newest)
    members = rounds.cut(members)
    ends = lambda c: members.select(F.col("id").alias(c))
    closed = within.join(ends("u"), "u", "left_semi").join(ends("v"), "v", "left_semi").select("colour").distinct()
    found = members.join(closed, "colour", "left_semi").select("id", F.col("colour").alias("component"))
    return rounds.cut(found), within.join(ends("u"), "u", "left_anti").join(ends("v"), "v", "left_anti").select("u", "v")


def _restored(found: DataFrame, taken: list[DataFrame], rounds: Rounds) -> DataFrame:
    """A link that was taken out is in a circle if both its neighbours are in one and the same component."""
    for links in reversed(taken):
        side = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
        own = links.join(side("before"), "before").join(side("after"), "after").filter("of_before = of_after")
        found = rounds.cut(found.unionByName(own.select(F.col("x").alias("id"), F.col("of_before").alias("component"))))
    return found


def components(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """id, component: the nodes that are in a circle, and the least node of their strongly connected component.

    A node with an edge to itself is in a circle. Repeated edges and edges with a null end change nothing; an acyclic graph gives no rows.
    """
    rows = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    found, taken = rows.limit(0).select(F.col("u").alias("id"), F.col("v").alias("component")), []
    with Rounds(edges.sparkSession) as rounds:
        # most of a graph is in no circle, and goes before repeats are looked for
        left = _trimmed(rounds.cut(rows)).repartition("u", "v").distinct()
        while True:
            left, more = reduced(left, rounds)
            taken += more
            if left.isEmpty():
                break
            some, left = _split(left, rounds)
            found = found.unionByName(some)
        found = rounds.cut(_restored(found, taken, rounds))
        least = found.groupBy("component").agg(F.min("id").alias("least"))
        return rounds.keep(found.join(least, "component").select("id", F.col("least").alias("component")))


def witnesses(edges: DataFrame, members: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """component, pos, id: one circle of each component, from its least node on, in the order of the edges.

    Every node of a component goes on to its least successor within it. Taken more often than there are nodes, these steps end on circles; steps
    are doubled each round, so the rounds grow with the logarithm of the nodes. Of a component's circles, that with the least node is kept, cut open
    there and numbered by doubling again.
    """
    with Rounds(edges.sparkSession) as rounds:
        rows = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
        of = lambda c: members.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
        within = rows.join(of("u"), "u").join(of("v"), "v").filter("of_u = of_v")
        step = rounds.cut(within.groupBy(F.col("u").alias("id"), F.col("of_u").alias("component")).agg(F.min("v").alias("next")))
        n, jump = step.count(), step
        for _ in range(n.bit_length()):
            jump = rounds.cut(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("further")), "next").select("id", "component", F.col("further").alias("next")))
        ends = jump.groupBy("component").agg(F.min("next").alias("id"))
        # the circle through that node: all that it leads to; the least node of it opens it
        on = rounds.cut(jump.select(F.col("next").alias("id"), "component").distinct().join(step.drop("component"), "id"))
        reach = rounds.cut(on.join(_ring_names(on, rounds), "id").select("id", "component", "next", "ring"))
        kept = reach.join(ends.select(F.col("id").alias("ring")), "ring", "left_semi")
        # numbered from the opening: how many steps are left until it comes again
        left = rounds.cut(kept.select("id", "component", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("left")))
        while not left.filter("next IS NOT NULL").isEmpty():
            far = left.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("left").alias("more"))
            left = rounds.cut(left.join(far, "next", "left").select("id", "component", F.col("further").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
        size = left.groupBy("component").agg(F.max("left").alias("size"))
        return rounds.keep(left.join(size, "component").select("component", (F.col("size") - F.col("left")).alias("pos"), "id"))


def _ring_names(on: DataFrame, rounds: Rounds) -> DataFrame:
    """id, ring: the least node of the circle that each node of a union of circles is on, by doubling."""
    now = rounds.cut(on.select("id", "next", F.col("id").alias("ring")))
    while True:
        far = now.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("ring").alias("other"))
        new = rounds.cut(now.join(far, "next").select("id", F.col("further").alias("next"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("fell")))
        now = new.drop("fell")
        if new.filter("fell").isEmpty():
            return now.select("id", "ring")
