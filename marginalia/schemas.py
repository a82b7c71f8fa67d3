"""Vocabularies, record types and rules of the curated network."""

from __future__ import annotations

from pyspark.sql import types as T

#: The vocabularies of node types, standings, states and relations.
NODE_TYPES = ("concept", "definition", "theorem", "lemma", "proposition", "corollary", "example", "construction", "computation", "conjecture", "open-problem", "project", "paper", "claim")
CLAIM_LIKE = ("claim", "theorem", "lemma", "proposition", "corollary", "conjecture", "open-problem", "computation")
STANDINGS = {"source-claimed": ("Source-claimed", "◇"), "proved": ("Proved", "■"), "verified": ("Verified", "✓"), "computational": ("Computational", "⌘"), "conjectural": ("Conjectural", "◇"), "open": ("Open problem", "?"), "abandoned": ("Abandoned", "×")}
EDITORIAL = {"draft": "Draft", "reviewed": "Reviewed", "curated": "Curated", "needs-review": "Needs review"}
PUBLICATION = {"draft": "Draft", "unpublished": "Unpublished", "preprint": "Preprint", "published": "Published"}
RELATION_TYPES = ("uses", "implies", "generalizes", "specializes", "example-of", "motivates", "depends-on", "obstructs", "related-to", "appears-in")
PROVENANCE = ("source-backed", "background", "research-direction")
METHODS = ("human", "human-source", "computational", "formal", "mixed")
REVIEW_STATES = ("NEW", "MATCHED", "POSSIBLE DUPLICATE", "CHANGED", "ACCEPTED", "REJECTED", "NEEDS REVIEW")
#: Sections of the index and the node types that each lists.
INDEX_SECTIONS = (
    ("Concepts", ("concept",)), ("Definitions", ("definition",)), ("Results", ("theorem", "lemma", "proposition", "corollary")), ("Examples", ("example",)),
    ("Constructions & computations", ("construction", "computation")), ("Open problems & conjectures", ("open-problem", "conjecture")), ("Claims", ("claim",)), ("Projects", ("project",)), ("Papers", ("paper",)),
)

#: Formats of identifiers. \z rather than $, which Java lets match before a last line feed.
IDENTIFIER = r"^[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+\z"
PROJECT_KEY = r"^[A-Z][A-Z0-9-]*\z"
ARXIV = r"^\d{4}\.\d{4,5}(v\d+)?\z"
COMMIT = r"^[a-f0-9]{40}\z"
DIGEST = r"^[a-f0-9]{64}\z"
REPOSITORY = r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\z"
SAFE_SEGMENT = r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"

_s, _i, _b = T.StringType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_strings = T.ArrayType(_s)
SPAN = struct(file=_s, startLine=_i, endLine=_i)
FILE = struct(path=_s, sha256=_s, bytes=T.LongType())
CITATION = struct(key=_s, title=_s, authors=_strings, year=_s, journal=_s, doi=_s, eprint=_s, url=_s)
RELATION = struct(target=_s, type=_s, note=_s)
REFERENCE = struct(title=_s, url=_s, note=_s)
SOURCE = struct(
    kind=_s, repository=_s, branch=_s, commit=_s, path=_s, paperDirectory=_s, sourceKey=_s, label=_s, environment=_s, section=_s, printedNumber=_s, startLine=_i, endLine=_i, contentHash=_s,
    retrievedAt=_s, acceptedAt=_s, statementLatex=_s, proofLatex=_s, macros=T.MapType(_s, _s), spans=T.ArrayType(SPAN), proofSpans=T.ArrayType(SPAN), files=T.ArrayType(FILE),
    citations=T.ArrayType(CITATION), paperMetadata=struct(title=_s, authors=_strings, abstract=_s),
)
NODE = struct(
    id=_s, title=_s, shortTitle=_s, type=_s, claimStanding=_s, editorialState=_s, publicationStatus=_s, summary=_s, date=_s, dateNote=_s, authors=_strings, projects=_strings, about=_strings, tags=_strings,
    references=T.ArrayType(REFERENCE), arxiv=_s, dependsOn=_strings, relations=T.ArrayType(RELATION), verification=struct(method=_s, note=_s), provenance=_s, timeline=struct(stage=_i, note=_s), sources=T.ArrayType(SOURCE),
)
#: What older records hold in place of the three status axes.
LEGACY = struct(status=_s, claimStatus=_s, project=_s)
PROJECT = struct(title=_s, short=_s, description=_s, anchor=_s, direction=_s)
SELECTION = struct(file=_s, startLine=_i, endLine=_i, selectedText=_s, contentHash=_s)
CONTEXT_SELECTION = struct(file=_s, startLine=_i, endLine=_i, selectedText=_s, contentHash=_s, role=_s)
FRAGMENT = struct(
    id=_s, kind=_s, source=struct(repository=_s, branch=_s, commit=_s, file=_s, paperDirectory=_s), container=struct(latexLabel=_s, environment=_s, printedNumber=_s),
    assertionSelections=T.ArrayType(SELECTION), contextSelections=T.ArrayType(CONTEXT_SELECTION), context=struct(sourceKey=_s, title=_s, paperTitle=_s, section=_s, statementScope=_s),
)
ATTESTATION = struct(id=_s, kind=_s, fragment=_s, target=_s, relation=_s, coverage=_s, review=struct(state=_s, method=_s, sourceCommit=_s, note=_s))
DECISION = struct(state=_s, contentHash=_s, nodeId=_s, commit=_s, reviewedAt=_s, note=_s)
LEDGER = struct(formatVersion=_i, decisions=T.MapType(_s, DECISION))
