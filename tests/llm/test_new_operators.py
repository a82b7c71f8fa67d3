"""Vector codes, the Merkle manifest and token files against plain versions, with odd rows everywhere."""

import base64
import gzip
import hashlib
import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connect, same

from marginalia.llm import host_reputation, merkle, token_files, vector_codes, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, leaf string, s long, bucket long, path string"
ODD = ["", " \t\n", "one", "é ü 日本語 \U0001f642 naïve", "it's  two   spaces\r\n", "<|endoftext|> and <|startoftext|>x", "A B C", "word " * 3000]


def docs(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names clash with helpers and results."""
    return spark.createDataFrame([(i, t, None if i and i % 7 == 0 else "en", s, len(t) if t else None, True, "x", 5, 6, "p") for i, t, s in rows], DOCS)


# vector codes


def plain_codes(rows, parts, entries, rounds, scale=1024):
    """rows: (vec_id, vector, label). Lists and loops only."""
    kept = [(i, [math.floor(scale * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(best(v, p)[1], []).append(cut(v, p))
            for e, vs in own.items():
                books[p][e] = [math.floor(sum(c) / len(vs)) if abs(sum(c)) < 1 << 40 else sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out = []
    for i, v, l in kept:
        found = [best(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), l))
    total = {}
    for *_, d, l in out:
        total[l] = total.get(l, 0) + d
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, d, total[l], digest) for i, c, d, l in out), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, id long, vector string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "c", 1, 2, "v") for i, v, l in rows], VECTORS)


def gathered(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_vector_codes(spark):
    rng = random.Random(3)
    f = lambda: float(np.float32(rng.choice([rng.gauss(0, 0.2), rng.choice([-0.5, 0.0, 0.25])])))
    rows = [(i, [f() for _ in range(8)], rng.choice([0, 0, 1, None])) for i in rng.sample(range(1000), 150)]
    rows += [(rows[0][0], rows[0][1], 1), (None, [f() for _ in range(8)], 0), (None, [0.0] * 8, None), (5000, None, 1), (5001, [0.1, None] * 4, 1), (5002, [math.nan] * 8, 1), (5003, [math.inf] + [0.0] * 7, 1), (5004, [-0.0001] * 8, 2)]
    rows += [(6000 + k, rows[1][1], 0) for k in range(60)]  # a common vector: ties between entries
    for entries, rounds in ((16, 4), (256, 4), (3, 0)):
        assert gathered(vector_codes.compress(vectors(spark, rows), entries=entries, rounds=rounds)) == plain_codes(rows, 4, entries, rounds)
    fewer = rows[:5]
    assert gathered(vector_codes.compress(vectors(spark, fewer))) == plain_codes(fewer, 4, 256, 4)


def test_vector_codes_odd(spark):
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 1), (2, [math.nan] * 4, 1), (3, [], 0), (4, [1.0] * 3, 0)])).collect() == []
    # other lengths than most have go; components past the bound count as it
    rows = [(1, [1e30, 0.0, 0.0, -1e30], 0), (2, [0.0] * 4, 0), (3, [0.0] * 8, 0), (4, [1.0] * 5, None)]
    found = {r.vec_id: r for r in vector_codes.compress(vectors(spark, rows), entries=1, rounds=0).collect()}
    most = vector_codes.bound(4)
    assert set(found) == {1, 2} and found[2].error == 2 * most * most and found[2].label_error == found[2].error
    # a label's sum past 64 bits is null
    rows = [(i, [1e30 * (-1) ** i] * 4, 7) for i in range(4)]
    assert {r.label_error for r in vector_codes.compress(vectors(spark, rows), entries=1, rounds=0).collect()} == {None}


@given(st.integers(0, 2**32), st.integers(1, 40), st.integers(1, 9), st.integers(1, 6))
@settings(max_examples=40, deadline=None)
def test_nearest(seed, n, k, d):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-3, 3, (n, d)), rng.integers(-3, 3, (k, d))
    at, error = vector_codes.nearest(x, book)
    far = ((x[:, None] - book) ** 2).sum(axis=2)
    assert at.tolist() == far.argmin(axis=1).tolist() and error.tolist() == far.min(axis=1).tolist()


# the Merkle manifest


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_manifest(rows, fan=16):
    """rows: what `docs` makes. Trees as lists of levels."""
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: H(*map(framed, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + fan]) for k in range(0, len(levels[-1]), fan)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            lo = i // fan * fan
            yield level[lo:i], level[i + 1 : lo + fan]
            i //= fan

    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))
    own = {s: sorted(by[s], key=order) for s in names}
    trees = {s: tree([leaf(r, r["text"]) for r in own[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    root = top[-1][0] if names else None
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(own[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            node = leaf(r, low(r["text"])) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else leaf(r, r["text"])
            for before, after in steps:
                node = H(*before, node, *after)
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], root, H(*(x for a, b in steps for x in (*a, *b))), node, node == root))
    return sorted(out, key=str)


def manifest_of(df, **settings):
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    low = F.translate("text", merkle.UPPER, merkle.LOWER)
    return gathered(merkle.manifest(df, altered={"text": low}, suspect=fifth, **settings))


@pytest.mark.parametrize(("fan", "inner", "block"), [(16, 3, 16_384), (2, 2, 10), (3, 1, 1), (4, 3, 100)])
def test_manifest(spark, fan, inner, block):
    rng = random.Random(fan)
    rows = [(i, f"Text {i} of Many" if i % 3 else f"text {i}", rng.choice(["a", "a", "a", "b", "é", "B", None])) for i in range(170)]
    rows += [(1000 + k, t, "odd") for k, t in enumerate(ODD)] + [(900, "Lone", "one leaf"), (None, "No ID", "a"), (None, None, None), (7, None, "")]
    rows += [(950, "Same Row", "a")] * 3 + [(950, "other Row", "a")]
    df = docs(spark, rows).repartition(5)
    assert manifest_of(df, fan=fan, inner=inner, block_leaves=block) == plain_manifest([r.asDict() for r in df.collect()], fan)


def test_manifest_small(spark):
    assert manifest_of(docs(spark, [])) == []
    one = docs(spark, [(3, "A", None)])
    assert manifest_of(one) == plain_manifest([r.asDict() for r in one.collect()])
    many = docs(spark, [(i, "T", f"s{i}") for i in range(40)])  # one leaf a source
    assert manifest_of(many) == plain_manifest([r.asDict() for r in many.collect()])


def test_manifest_tampering(spark):
    """A changed field of any kind breaks the proof of its row alone; without changes, all hold."""
    df = docs(spark, [(i, f"t{i}", "ab"[i % 2]) for i in range(50)])
    assert all(r.verified for r in merkle.manifest(df).collect())
    for changed in ({"lang": F.lit(None).cast("string")}, {"n_chars": F.col("n_chars") + 1}, {"text": F.concat("text", F.lit(" "))}):
        found = merkle.manifest(df, altered=changed, suspect=F.col("doc_id") == 11).collect()
        assert [r.doc_id for r in found if not r.verified] == [11] and len({r.root for r in found}) == 1


# token files


@pytest.fixture(scope="module")
def tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=700), st.booleans())
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, clustered):
    values = sorted(v >> 50 if clustered else v for v in values)
    made = token_files.EliasFano.of(np.array(values, np.int64))
    ef = token_files.EliasFano.from_bytes(made.to_bytes())
    assert ef.part(0, len(values)).tolist() == values
    assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7]
    for lo, hi in ((1, 300), (255, 257), (256, 600), (len(values), len(values))):
        assert ef.part(min(lo, len(values)), min(hi, len(values))).tolist() == values[lo:hi]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_size():
    rng = np.random.default_rng(1)
    values = np.cumsum(rng.integers(1, 2000, 100_000))
    bits = 8 * len(token_files.EliasFano.of(values).to_bytes()) / len(values)
    assert bits < 2 + math.ceil(math.log2(values[-1] / len(values))) + 0.2  # 64 in a table of offsets
    ef = token_files.EliasFano.of(np.concatenate([np.zeros(5000, np.int64), np.full(5000, 1 << 40)]))  # a long gap in the high bits
    assert [ef.select(i) for i in (0, 4999, 5000, 9999)] == [0, 0, 1 << 40, 1 << 40]


def test_encoder(tokenizer):
    assert token_files.regular(tokenizer)
    enc, rng = token_files.Encoder(tokenizer, True), random.Random(2)
    known = [chr(i) for i in np.flatnonzero(token_files.characters()[0] != token_files.UNKNOWN)]
    texts = [" ".join(f"a{c}b {c} {c}1{c}- {rng.choice(known)}{c}{rng.choice(known)}" for c in known[lo : lo + 200]) for lo in range(0, len(known), 200)]
    bits = ["'", "''", "s", "t", "re", "ve", "m", "ll", "D", "Lé", "-", " ", "  ", "\n", "12", "½", "é", "́", "İ", "Σ", "日", "<|endoftext|>", "\x00", "\x1f", "\x85", " ", "क्", "\U0001f642", "\U0002fa1e"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)] + ODD
    ids, counts = enc.encode(texts)
    assert np.split(ids, np.cumsum(counts)[:-1])[-1].tolist() == enc.whole(texts[-1]).tolist()
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == enc.whole(t).tolist(), t
        at += n


def plain_tokens(rows, tokenizer):
    from tokenizers import Tokenizer

    full, start, out = Tokenizer.from_file(tokenizer), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_tokens", [1 << 26, 2000, 1])
def test_token_files(spark, tmp_path, tokenizer, file_tokens):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *ODD, f"text number {i}"])) for i in rng.sample(range(-50, 3000), 200)] + [(1 << 62, "far"), (-(1 << 62), "low")]
    made = token_files.write_files(docs(spark, [(*r, "s") for r in rows]).repartition(4), f"file://{tmp_path}/x", tokenizer, file_tokens=file_tokens)
    assert sum(r.documents for r in made.collect()) == len(rows)
    for piece in (1 << 21, 50):
        assert sorted(map(tuple, token_files.read_files(made, piece).collect()), key=lambda r: r[1]) == plain_tokens(rows, tokenizer)


def test_token_files_repeats(spark, tmp_path, tokenizer):
    """Rows without a number come first; each row that repeats one has its own place."""
    rows = [(None, "a"), (None, None), (5, "b c"), (5, "b c"), (5, "d"), (6, "")]
    made = token_files.write_files(docs(spark, [(*r, "s") for r in rows]), f"file://{tmp_path}/x", tokenizer)
    found = sorted(map(tuple, token_files.read_files(made).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, None, 5, 5, 5, 6] and all(a[1] + a[2] == b[1] for a, b in zip(found, found[1:], strict=False))
    assert sorted((r[2], r[3]) for r in found) == sorted(r[2:] for r in plain_tokens(rows, tokenizer))
    assert token_files.read_files(token_files.write_files(docs(spark, []), f"file://{tmp_path}/y", tokenizer)).collect() == []


def test_token_file_access(spark, tmp_path, tokenizer, monkeypatch):
    """Any document by its place or number; a long text in pieces gives the ids of the whole."""
    monkeypatch.setattr(token_files, "TEXT_CHARS", 1000)
    enc = token_files.Encoder(tokenizer, True)
    texts = ["x " * 700 + "é", "short", "no_space" * 400, "one, two " * 600, "", "end"]
    got, counts, held = [], [], 0
    for k, ids, n in enc.pieces(texts):
        got.append(ids)
        counts += [] if k < 0 else (np.array(n) + [held, *[0] * (len(n) - 1)]).tolist()
        held = held + int(n.sum()) if k < 0 else 0
    assert np.concatenate(got).tolist() == [x for t in texts for x in enc.whole(t).tolist()] and counts == [len(enc.whole(t)) for t in texts]
    monkeypatch.undo()
    rows = [(None, "none")] + [(3 * i, t) for i, t in enumerate(texts)]
    made = token_files.write_files(docs(spark, [(*r, "s") for r in rows]).coalesce(1), f"file://{tmp_path}/z", tokenizer).collect()
    seen = {}
    for r in made:
        file = token_files.TokenFile(r.path)
        for k in range(file.n):
            seen[file.number(k)] = file.document(k).tolist()
            assert file.number(k) is None or file.find(file.number(k)) == k
        assert file.find(1) == -1
        file.close()
    assert seen == {i: [*enc.whole(t).tolist(), 1] for i, t in rows}


@pytest.mark.parametrize("module", [vector_codes, merkle])
def test_against_sql(spark, module):
    sf = "/root/testdata/sf0.01"
    query = {vector_codes: vector_codes.op11_vector_codes, merkle: merkle.op12_merkle_manifest}[module]
    assert same(query(spark, sf), connect(sf), module.ORACLE_SQL) > 0


# archives that others wrote


def foreign_records():
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    page = b"<html>" + b"x" * 200_000 + b"\r\n\r\n</html>"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(page).digest()).decode()
    rows = [
        ("warcinfo", "application/warc-fields", None, b"software: other\r\nformat: WARC File Format 1.0\r\n\r\n", None), ("request", "application/http; msgtype=request", "http://a/", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", None), ("response", "application/http; msgtype=response", "http://a/", http + page, sha1),
        ("metadata", "text/plain", "http://a/", b"", None), ("response", "text/dns", "dns:a", b"20200101\r\na. 1 IN A 1.2.3.4", None), ("response", "application/http", "http://b/", b"broken", None), ("resource", "image/png", "http://c/", bytes(range(256)) * 300, None),
    ]
    out, wanted = [], []
    for k, (kind, mime, uri, block, digest) in enumerate(rows):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{k}>", *([f"WARC-Target-URI: {uri}"] if uri else []), *([f"WARC-Payload-Digest: {digest}"] if digest else []), f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
        out.append("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
        payload = {1: b"", 2: page, 5: b""}.get(k, block)
        wanted.append((f"urn:uuid:{k}", kind, uri, len(payload), payload))
    return out, wanted


def test_foreign_archives(spark, tmp_path):
    records, wanted = foreign_records()
    forms = {"each": b"".join(map(gzip.compress, records)), "one": gzip.compress(b"".join(records)), "two": gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:])) + b"\0" * 512}
    for name, data in forms.items():
        (tmp_path / name / "deep").mkdir(parents=True)
        (tmp_path / name / "deep/x.warc.gz").write_bytes(data)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/x.WARC").write_bytes(b"".join(records))
    for name in (*forms, "plain", "plain/x.WARC"):
        path = f"file://{tmp_path}/{name}"
        got = [(r.record_id, r.warc_type, r.target_uri, r.payload_length, bytes(r.payload)) for r in warc.read(spark, path, verify="true").collect()]
        assert got == wanted, name
        assert [(r.record_id, r.payload_length, r.payload) for r in warc.read(spark, path, payload="false").collect()] == [(w[0], w[3], None) for w in wanted]
        assert [r.record_id for r in warc.read(spark, path).filter("warc_type = 'resource'").collect()] == ["urn:uuid:6"]


def test_foreign_beside_own(spark, tmp_path):
    """Foreign archives are read beside ours; of our own names, only what a manifest lists; no archive is an error."""
    records, wanted = foreign_records()
    path = f"file://{tmp_path}/x"
    pages = spark.createDataFrame([(1, "http://a", "<a>"), (2, None, None)], "page_id long, url string, html string")
    warc.write(warc.records_of(pages), path)
    (tmp_path / "x/theirs.warc").write_bytes(b"".join(records))
    (tmp_path / f"x/part-{'a' * 32}.warc.gz").write_bytes(gzip.compress(records[0]))  # a failed attempt's
    assert {r.record_id for r in warc.read(spark, path).collect()} == {w[0] for w in wanted} | {"urn:x-page:1", "urn:x-page:2"}
    for bad in ("none", "empty"):
        (tmp_path / "empty").mkdir(exist_ok=True)
        with pytest.raises(Exception, match="no archive at"):
            warc.read(spark, f"file://{tmp_path}/{bad}").collect()
    (tmp_path / "empty/x.warc").write_bytes(b"this is no archive")
    with pytest.raises(Exception, match="not a WARC record"):
        warc.read(spark, f"file://{tmp_path}/empty").collect()


def test_reputation_decides(spark, tmp_path):
    """Hosts on both sides of the bound, in numbers like a table's, against the SQL: bad ones, good ones, and ones with few labels that follow their domain."""
    rng, pages, labels = random.Random(6), [], []
    for host, n, rate, told in (("a.bad.test", 300, 0.6, 0.7), ("b.bad.test", 40, 0.5, 0.3), ("new.bad.test", 20, 0.0, 0.0), ("a.good.test", 400, 0.03, 0.5), ("b.good.test", 60, 0.0, 0.1), ("edge.test", 200, 0.17, 0.9), ("small.other", 3, 1.0, 1.0)):
        for _ in range(n):
            i = len(pages)
            pages.append((i, f"https://{host}/p/{i}", "<p>"))
            if rng.random() < told:
                labels.append((i, int(rng.random() >= rate), 0))
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).toPandas().to_parquet(tmp_path / "pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).toPandas().to_parquet(tmp_path / "labels.parquet")
    judged = host_reputation.op5_host_reputation(spark, str(tmp_path))
    assert same(judged, connect(str(tmp_path)), host_reputation.ORACLE_SQL) == len(pages)
    verdicts = {r.host: (r.verdict, r.sure) for r in judged.collect()}
    assert {h for h, (v, _) in verdicts.items() if v == "block"} >= {"a.bad.test", "b.bad.test"} and {h for h, (v, _) in verdicts.items() if v == "allow"} >= {"a.good.test", "b.good.test", "edge.test"}
    assert 0.05 < verdicts["edge.test"][1] < 0.95 and verdicts["new.bad.test"][1] > verdicts["b.good.test"][1]


def test_reputation_rules_are_the_contracts(spark):
    """net/de/ allows, also hosts that are surely bad, and example.net/de/8 below it blocks."""
    urls = [f"https://x.net/fr/{i}" for i in range(60)] + ["https://x.net/de/1", "https://x.net/de/8", "https://a.example.net/de/8", "https://a.example.net/de/7"]
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    bad = spark.createDataFrame([(i, True) for i in range(60)], "page_id long, bad boolean")
    seen = {r.page_id: (r.rule, r.verdict) for r in host_reputation.judge(pages, bad).collect()}
    assert seen[0] == (None, "block")
    assert [seen[i] for i in range(60, 64)] == [("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow")]
