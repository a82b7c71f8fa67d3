"""Secret scans with multipart credential linking.

One Arrow pass over whole texts finds three base kinds of secrets by pattern. The method adds the parts of a credential that are weak on
their own: identifiers (`id`), high-entropy strings (`key`) and endpoints (`endpoint`). Parts are intervals; a part and its complement are
linked if the gap between them is at most `scope` characters and no blank line stands between. Within a text this is an interval join: the
parts of a role are sorted by their ends and by their starts, and a binary search finds the nearest before and behind, which decide for all
others; so a text of n parts takes n log n steps. Weak parts are reported only where an identifier and a secret, or a secret and an endpoint, co-occur that way.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import spread, table, tidy

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Weak parts. An identifier or endpoint needs its keyword or scheme; a key needs mixed character classes and entropy.
ID = re.compile(r"\b(?:user(?:_?name)?|login|client_?id|access_?key(?:_?id)?|account)[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?([A-Za-z0-9_.@-]{3,})", re.ASCII | re.IGNORECASE)
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
ENDPOINT = re.compile(r"\b(?:[a-z][a-z0-9+]{1,15}://[^\s\"'<>]+|(?:host|endpoint|server)[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?[A-Za-z0-9.-]+(?::\d+)?)", re.ASCII | re.IGNORECASE)
SCOPE = 200
LEAST_ENTROPY = 3.5
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

Span = tuple[int, int, str]


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def base_spans(text: str) -> list[Span]:
    """The three base kinds; offsets in code points, end exclusive."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if "=" in text or ":" in text else []
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def strong_key(text: str) -> bool:
    classes = sum(any(t(c) for c in text) for t in (str.islower, str.isupper, str.isdigit))
    return classes == 3 and entropy(text) >= LEAST_ENTROPY


def weak_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), "id") for m in ID.finditer(text)] if "=" in text or ":" in text else []
    found += [(m.start(), m.end(), "key") for m in KEY.finditer(text) if strong_key(m[0])]
    return found + ([(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if "=" in text or ":" in text else [])


#: The role of each kind, and which roles complete each other.
ROLE = {"access": "who", "id": "who", "assign": "what", "hex": "what", "key": "what", "endpoint": "where"}
COMPLETES = {"who": ("what",), "what": ("who", "where"), "where": ("what",)}


class Parts:
    """The intervals of one role. Of those before a position the nearest is the one that ends last, of those behind the one that starts first."""

    def __init__(self, spans: list[Span]):
        self.ends, self.starts = sorted(s[1] for s in spans), sorted(s[0] for s in spans)

    def near(self, at: Span, scope: int, breaks: list[int]) -> bool:
        """Whether an interval lies within scope of `at`, doesn't overlap it, and shares its paragraph. A farther one fits only if the nearest does."""
        before, behind = bisect.bisect_right(self.ends, at[0]), bisect.bisect_left(self.starts, at[1])
        gaps = ([(self.ends[before - 1], at[0])] if before else []) + ([(at[1], self.starts[behind])] if behind < len(self.starts) else [])
        return any(hi - lo <= scope and bisect.bisect_left(breaks, lo) == bisect.bisect_left(breaks, hi) for lo, hi in gaps)


def link(base: list[Span], weak: list[Span], text: str, scope: int = SCOPE) -> list[Span]:
    """The weak spans that a complementary part completes."""
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    by_role: dict[str, list[Span]] = {"who": [], "what": [], "where": []}
    for s in {*base, *weak}:
        by_role[ROLE[s[2]]].append(s)
    parts = {r: Parts(spans) for r, spans in by_role.items()}
    return [s for s in weak if any(parts[r].near(s, scope, breaks) for r in COMPLETES[ROLE[s[2]]])]


def order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in order(spans))


def scan_text(text: str, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """Base spans, and the linked weak ones."""
    base = base_spans(text)
    taken = {(a, b) for a, b, _ in base}
    weak = [s for s in weak_spans(text) if (s[0], s[1]) not in taken]
    return base, link(base, weak, text, scope)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Counts, digest and spans for every row.

    A null or empty text has no spans, an empty string of spans and the digest of an empty string. Rows that repeat an id give a row each;
    a null id stays null. Other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                base, linked = scan_text(value.as_py() or "", scope)
                kinds = Counter(k for _, _, k in base)
                out.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + linked)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return spread(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")).mapInArrow(tidy(run), SCHEMA)


def op4_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
