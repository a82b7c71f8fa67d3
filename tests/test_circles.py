"""Strongly connected components and witness circles against reachability."""

import random

from marginalia.operators import circles, validate


def reach(links):
    out = {}
    for u in {x for l in links for x in l if None not in l}:
        seen, todo = set(), [v for a, v in links if a == u and v is not None]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [v for a, v in links if a == x and v is not None]
        out[u] = seen
    return out


def plain(links):
    """Component of each node that reaches itself: the least node that it reaches and that reaches it."""
    to = reach(links)
    return {u: min(v for v in to[u] if u in to[v]) for u in to if u in to[u]}


TWO_RINGS = [(0, 1), (1, 0), *((i, i + 1) for i in range(1, 12)), (12, 13), (13, 12), (20, 0), (13, 21)]
GRAPHS = {
    "chain": [(i, i + 1) for i in range(60)], "ring": [(i, (i + 1) % 30) for i in range(30)], "rings joined by a path": TWO_RINGS, "loop": [(1, 1), (1, 2), (None, 1), (2, None)],
    "chord": [(0, 1), (1, 2), (2, 0), (0, 2)], "hub": [(0, i) for i in range(1, 40)] + [(i, 0) for i in range(20, 40)],
    "ladder": [(i, i + 1) for i in range(25)] + [(i + 1, i) for i in range(25)] + [(25, 30), (30, 31), (31, 30)],
}
rng = random.Random(7)
GRAPHS |= {f"random {k}": [(rng.randrange(14), rng.randrange(14)) for _ in range(15 + k)] for k in range(6)}


def test_components(spark):
    """All graphs at once, side by side."""
    links = [tuple(x if x is None else 1000 * k + x for x in l) for k, name in enumerate(GRAPHS) for l in GRAPHS[name]]
    edges = spark.createDataFrame(links + links[:90], "source long, target long")
    members = circles.components(edges)
    got = [tuple(r) for r in members.collect()]
    wanted = {u: c for k, name in enumerate(GRAPHS) for u, c in plain([tuple(x if x is None else 1000 * k + x for x in l) for l in GRAPHS[name]]).items()}
    assert len(got) == len(set(got)) and dict(got) == wanted
    seen = {}
    for r in sorted(circles.witnesses(edges, members).collect(), key=lambda r: (r.component, r.pos)):
        seen.setdefault(r.component, []).append((r.pos, r.id))
    assert set(seen) == set(wanted.values())
    for component, path in seen.items():
        ids = [i for _, i in path]
        assert [p for p, _ in path] == list(range(len(path))) and len(set(ids)) == len(ids) and ids[0] == min(ids)
        assert all(wanted[i] == component for i in ids) and all((a, b) in links for a, b in zip(ids, [*ids[1:], ids[0]], strict=True))


def test_no_circles(spark):
    for links in ([], [(1, 2), (None, 1), (2, None)]):
        edges = spark.createDataFrame(links, "source long, target long")
        members = circles.components(edges)
        assert members.collect() == [] and circles.witnesses(edges, members).collect() == []


def test_rule_names_members_only(spark):
    """Not what lies between two circles."""
    edges = spark.createDataFrame([(f"N-{a:02}", f"N-{b:02}", "depends-on") for a, b in TWO_RINGS], "id string, target string, type string")
    ids = spark.createDataFrame([(f"N-{i:02}",) for i in range(22)], "id string")
    found = validate.network(ids, edges).filter("rule = 'cycle'").collect()
    assert {(r.id, r.detail) for r in found} == {(f"N-{i:02}", "in a circle of dependencies") for i in (0, 1, 12, 13)}
