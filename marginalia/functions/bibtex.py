"""BibTeX entries from text, in plain Python and as a table function."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .tex import Scan

ENTRY = re.compile(r"@([A-Za-z]+)\s*([({])")
FIELD = re.compile(r"[\s,]*([\w-]+)\s*=\s*", re.ASCII)
GAP = re.compile(r"\s*")
BARE = re.compile(r"[^,\s#]+")
PIECES = "key string, entry_type string, authors array<string>, title string, year string, journal string, doi string, eprint string, url string, fields map<string,string>, raw string, source_file string"


class Unclosed(ValueError):
    pass


def value_at(scan: Scan, at: int, strings: dict[str, str]) -> tuple[str, int]:
    """A field's value from an offset on, its pieces joined, and the offset behind it."""
    text, out = scan.text, []
    while True:
        at = GAP.match(text, at).end()
        sign = text[at : at + 1]
        if sign == "{":
            if (group := scan.group(at)) is None:
                raise Unclosed
            out.append(group.value)
            at = group.end
        elif sign == '"':
            end = quote_end(text, at + 1)
            out.append(text[at + 1 : end])
            at = end + 1
        elif bare := BARE.match(text, at):
            out.append(strings.get(bare[0].lower(), bare[0]))
            at = bare.end()
        at = GAP.match(text, at).end() if at < len(text) else at
        if text[at : at + 1] != "#" or not sign:
            return "".join(out), at
        at += 1


def quote_end(text: str, at: int) -> int:
    """The closing quote outside braces; the end of the text if there is none."""
    depth = 0
    for m in re.compile(r"\\.|[{}\"]", re.DOTALL).finditer(text, at):
        depth += (m[0] == "{") - (m[0] == "}")
        if m[0] == '"' and depth == 0:
            return m.start()
    return len(text)


def fields_of(content: str, strings: dict[str, str], key: str, say) -> dict[str, str]:
    """Field names in lower case and their values; a later field of the same name wins."""
    scan, at, out = Scan(content, masked=True), 0, {}
    while True:
        found = FIELD.match(content, at)
        if not found:
            if content[at:].strip(" \t\r\n,"):
                say("warning", f"Unparsed BibTeX field in {key or '@string'}")
            return out
        try:
            out[found[1].lower()], at = value_at(scan, found.end(), strings)
        except Unclosed:
            say("error", f"Unclosed field in {key}")
            return out


def parse(text: str, source_file: str) -> tuple[list[dict], list[dict]]:
    """Entries and diagnostics of one bibliography."""
    entries, told, strings, seen = [], [], {}, set()
    say = lambda severity, message: told.append({"severity": severity, "file": source_file, "line": None, "message": message})
    scan, at = Scan(text, masked=True), 0
    while m := ENTRY.search(text, at):
        kind = m[1].lower()
        body = scan.group(m.end() - 1, "{}" if m[2] == "{" else "()")
        if body is None:
            say("error", f"Unclosed BibTeX {kind} entry")
            break
        at = body.end
        if kind in ("comment", "preamble"):
            continue
        if kind == "string":
            strings |= fields_of(body.value, strings, "", say)
            continue
        key, comma, content = body.value.partition(",")
        key = key.strip()
        if not comma or not key:
            say("warning", "BibTeX entry has no key")
            continue
        f = fields_of(content, strings, key, say)
        if key in seen:
            say("error", f"Duplicate bibliography key: {key}")
        seen.add(key)
        entries.append({
            "key": key, "entry_type": kind, "authors": [a for a in re.split(r"(?i)\s+and\s+", f.get("author", f.get("editor", ""))) if a], "title": f.get("title"), "year": f.get("year"),
            "journal": f.get("journal", f.get("booktitle")), "doi": f.get("doi"), "eprint": f.get("eprint", f.get("arxiv")), "url": f.get("url"), "fields": f, "raw": text[m.start() : body.end], "source_file": source_file,
        })
    return entries, told


@F.udtf(returnType=PIECES)
class BibtexEntries:
    """A row for each entry of a bibliography: `LATERAL bibtex_entries(text, file)` once registered."""

    def eval(self, text: str, source_file: str):
        for e in parse(text or "", source_file)[0]:
            yield tuple(e[c.split()[0]] for c in PIECES.split(", "))
