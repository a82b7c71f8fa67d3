"""The pipeline's stages against plain versions of themselves, on a small table with odd rows and clashing columns."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute
from test_operators import DOCS, ITEM, ODD, prose

import corpus_pipeline
from marginalia.llm import decontaminate, toxicity

COLUMNS = DOCS + ", predicted int, gone_id long, tag string, doc_tokens long"
STAGES = dict(corpus_pipeline.STAGES)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables: 200 clean documents, toxic ones, exact and near copies, leaks, odd and repeated rows."""
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.choice([8, 30, 80]))) for i in range(100, 300)]
    rows += [(300 + i, f"{prose(rng, 20)} you idiot moron {prose(rng, 5)} stupid scum") for i in range(80)]
    rows += [(400 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(20)]
    for i in range(20, 40):
        w = rows[i][1].split()
        rows.append((500 + i, " ".join([*w[:-1], "changed"]) if len(w) == 80 else prose(rng, 10)))
    rows += [(600, f"Look: {ITEM} Yes."), (601, ITEM.replace("12", "40").replace("Maria", "Pedro")), (602, f"{prose(rng, 25)} {ITEM.lower()} {prose(rng, 25)}"), (603, "A shop sells 12 pens.")]
    rows += [*ODD, (700, "twice the same row here"), (700, "twice the same row here"), (701, "an id with two texts"), (701, "and another text of it entirely"), (None, "an id with two texts"), (702, prose(rng, 5_000))]
    root = str(tmp_path_factory.mktemp("tables"))
    table = spark.createDataFrame([(i, t, "en", 7, False, 8, True, 0.5, 9, 3, "x", 4) for i, t in rows], COLUMNS).repartition(4)
    table.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(300 <= i < 380), 1) for i, _ in rows if i is not None] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, ITEM), (3, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_against_plain_versions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns

    def step(name):
        nonlocal docs
        was = rows_of(docs)
        docs = spark.createDataFrame(STAGES[name](spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns
        now = rows_of(docs)
        assert not now - was and now  # no row is made up or changed
        return was, now

    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    was, now = step("toxicity")
    kept = {r for r in was if model.score(toxicity.np.array([toxicity.features(r[1] or "", model.lexicon)]))[0] < 0.5}
    assert now == Counter({r: n for r, n in was.items() if r in kept}) and sum(300 <= (r[0] or 0) < 380 for r in now) < 4 and sum(100 <= (r[0] or 0) < 300 for r in now) > 195

    was, now = step("exact dedup")
    best = {}
    for r in was:
        if r[0] is not None:
            best[lower(r[1])] = max(best.get(lower(r[1]), r[0]), r[0])
    assert now == Counter({r: n for r, n in was.items() if best.get(lower(r[1])) == r[0]})

    was, now = step("simhash near-dedup")
    gone = brute.near_copies([r[:2] for r in was])
    assert now == Counter({r: n for r, n in was.items() if r[:2] not in gone}) and len(gone) > 3

    was, now = step("benchmark decontamination")
    assert now == Counter({r: n for r, n in was.items() if r[0] is None or r[1] is None or not brute.holds(r[1], ITEM)})
    assert {r[0] for r in was - now} == {600, 601, 602}

    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = STAGES["packing"](spark, docs, small).collect()
    want = Counter({(r[0], len(full.encode(r[1] or "", add_special_tokens=False).ids) + 1): n for r, n in now.items()})
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id, r.doc_tokens] += r.length
    assert tokens == Counter({(i, n): n * k for (i, n), k in want.items()})


def test_stages_on_empty_tables(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decontamination_against_definition(spark):
    """Names, numbers, units, case and broken slots: the same items as by the definition, document by document."""
    rng = random.Random(12)
    people, things = "Ann Ben Cleo Dan Eve Finn".split(), "pens apples books stamps coins shells".split()

    def problem():
        a, b = rng.sample(people, 2)
        x, y = rng.sample(things, 2)
        n, m, k = (rng.randint(2, 99) for _ in range(3))
        return rng.choice([
            f"{a} has {n} {x}. Then {b} gives {a} another {m} {x} and takes {k} {y} home. How many {x} does {a} have now?",
            f"A farm sells {x} at {n} cents each and {y} at {m} cents each, so what does {b} pay for {k} kg of both?",
            f"{n} + {m} = ?", f"{a} {b} {n} {m} {k}", f"count the {x}", "数学の問題です", f"In {n} days, {a} walks {m} km; {b} walks {k} km more. Who is first?",
        ])

    items = [(i, problem()) for i in range(14)]

    def changed(text):
        for _ in range(3):
            a, b = rng.sample(people, 2)
            text = text.replace(a, "\0").replace(b, a).replace("\0", b)
        out = [str(rng.randint(2, 99)) if w.isdigit() and rng.random() < 0.7 else w for w in text.split(" ")]
        if rng.random() < 0.3:
            out[rng.randrange(len(out))] = rng.choice(people)
        text = " ".join(out)
        return rng.choice([str, str.lower, str.upper, lambda t: f'("{t}")'])(text)

    docs = []
    for i in range(160):
        own = rng.choice(items)[1]
        docs.append((i, rng.choice([own, changed(own), changed(own), f"{prose(rng, 6)}. {changed(own)} {prose(rng, 6)}", problem(), own[: len(own) // 2]])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: list(r["items"]) for r in decontaminate.flag(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: [j for j, item in items if brute.holds(t, item)] for i, t in docs}
    assert got == want and 40 < sum(map(bool, want.values())) < 150


def test_decontamination_of_repeated_ids_and_partial_copies(spark):
    items = spark.createDataFrame([(1, ITEM), (2, ITEM), (9, "数学の問題です")], "item_id long, text string")
    half = " ".join(ITEM.split()[:19])
    rows = [(1, ITEM), (1, "clean text"), (1, ITEM), (2, f"so {half} and on"), (3, "これは数学の問題ですか"), (4, None), (None, ITEM)]
    got = [(r.doc_id, list(r["items"]), round(r.partial, 2)) for r in decontaminate.flag(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, [], 0.0), (1, [1, 2], 1.0), (1, [1, 2], 1.0)]
    assert [x[1] for x in got if x[0] == 2] == [[]] and 0.4 < next(x[2] for x in got if x[0] == 2) < 0.8
    assert [x[1] for x in got if x[0] == 3] == [[9]] and all(x[1] == [] for x in got if x[0] in (4, None))
    left = decontaminate.remove_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert Counter(map(tuple, left)) == Counter([(1, "clean text"), rows[3], (4, None), (None, ITEM)])
