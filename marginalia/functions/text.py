"""Column functions over strings. All are built of native expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a subject.
STOP_WORDS = "the a an of for in on and to with is are admits full source result let then this that from category categories".split()
#: White space as scripts in browsers see it: also no-break spaces and the byte order mark.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def line_feeds(c: Column) -> Column:
    """CRLF and CR become LF, as before every hash."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def words(c: Column) -> Column:
    """Distinct words of three letters or more, without stop words. Accents are not decomposed here; functions.tex.words does that."""
    low = F.regexp_replace(F.lower(c), r"x\s*_?\s*\{?10\}?", "x10")
    found = F.regexp_extract_all(low, F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over those of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def round_half_up(c: Column, places: int) -> Column:
    """floor(x * 10^p + 0.5) / 10^p: the same in every engine, where round() differs on ties."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


def escape_html(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def embed_json(c: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.replace(F.to_json(c), F.lit("<"), F.lit("\\u003c"))


def safe_url(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)^https?://"), c)


def encode_segment(c: Column) -> Column:
    """Percent-encoding of one path segment that leaves letters, digits and -_.!~*'() alone."""
    c = F.url_encode(c)
    for code, raw in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def encode_path(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "/"), encode_segment), "/")


def source_links(root: Column, repository: Column, branch: Column, commit: Column, path: Column, start: Column, end: Column) -> dict[str, Column]:
    """Links to a file at its commit, on its branch, and to its history; lines only if there is a first one."""
    base = F.concat(root, F.lit("/"), encode_path(repository))
    lines = F.when(start.isNull() | (start == 0), F.lit("")).otherwise(F.concat(F.lit("#L"), start.cast("string"), F.when(end.isNull() | (end == 0), F.lit("")).otherwise(F.concat(F.lit("-L"), end.cast("string")))))
    at = encode_path(path)
    return {
        "pinned": F.concat(base, F.lit("/blob/"), encode_segment(commit), F.lit("/"), at, lines),
        "current": F.concat(base, F.lit("/blob/"), encode_segment(branch), F.lit("/"), at),
        "history": F.concat(base, F.lit("/commits/"), encode_segment(branch), F.lit("/"), at),
    }


def site_url(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, r"/\z", ""), F.lit("/"), F.regexp_replace(path, r"^/", ""))


def anchor(key: Column) -> Column:
    """The name by which a review page's proposal is linked to."""
    return F.concat(F.lit("proposal-"), encode_segment(key))


def node_url(base: Column, id: Column) -> Column:
    return site_url(base, F.concat(F.lit("node/"), id, F.lit("/")))


def arxiv_base(c: Column) -> Column:
    return F.regexp_replace(c, r"v\d+\z", "")


def directory_arxiv(c: Column, number: str = r"\d{4,5}") -> Column:
    """A directory that is named after an identifier; number: the pattern of what follows its month."""
    return F.when(c.rlike(rf"^\d{{4}}\.{number}\z"), c)


def suggested_id(paper: Column, key: Column) -> Column:
    """P<paper>-<SLUG>-<six digits of the key's hash>."""
    slug = F.regexp_replace(F.regexp_replace(key, r"^label:", ""), r"[^A-Za-z0-9]+", "-")
    slug = F.left(F.upper(F.regexp_replace(slug, r"^-|-\z", "")), F.lit(55))
    return F.concat(F.lit("P"), F.regexp_replace(paper, r"[^A-Za-z0-9]+", "-"), F.lit("-"), slug, F.lit("-"), F.upper(F.left(F.sha2(key, 256), F.lit(6))))


def paper_id(paper: Column) -> Column:
    return F.concat(F.lit("P"), F.regexp_replace(paper, r"\W", "-"), F.lit("-PAPER"))


def pad_start(c: Column, n: int, fill: str) -> Column:
    """Pads, but never cuts as lpad does."""
    return F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, fill))


def pad_end(c: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, fill))


def type_label(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(" "))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """A small fixed dictionary as an expression; null for what it doesn't list."""
    return F.get(F.map_values(F.map_filter(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), lambda k, _: k == c)), 0)


def short_commit(c: Column) -> Column:
    """A commit as lists show it."""
    return F.left(c, F.lit(12))


def long_date(c: Column) -> Column:
    return F.date_format(c, "d MMMM yyyy")


def first_line(text: Column, part: Column) -> Column:
    """Line feeds before the first occurrence of part; null if it doesn't occur."""
    at = F.instr(text, part)
    return F.when(at > 0, F.length(F.left(text, at - 1)) - F.length(F.replace(F.left(text, at - 1), F.lit("\n"), F.lit(""))))


def line_count(c: Column) -> Column:
    """Lines of a selection; a last line feed doesn't begin another."""
    n = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1
    return F.greatest(n - F.when(c.endswith("\n"), 1).otherwise(0), F.lit(1))


def title_or(title: Column, environment: Column, label: Column, number: Column, id: Column) -> Column:
    return F.coalesce(title, F.concat_ws(" ", environment, F.coalesce(label, number, id)))


def equations(statement: Column) -> Column:
    """Displayed equations, delimiters included."""
    kinds = r"(?:equation\*?|align\*?|gather\*?)"
    return F.regexp_extract_all(statement, F.lit(rf"(?s)\\\[.*?\\\]|\$\$.*?\$\$|\\begin\{{{kinds}\}}.*?\\end\{{{kinds}\}}"), F.lit(0))


def bib_authors(author: Column, editor: Column) -> Column:
    return F.filter(F.split(F.coalesce(author, editor, F.lit("")), r"(?i)\s+and\s+"), lambda a: a != "")


def bibliography_line(authors: Column, title: Column, year: Column, journal: Column) -> Column:
    return F.concat_ws(", ", F.when(F.size(authors) > 0, F.array_join(authors, "; ")), title, year, journal)


def canonical_url(origin: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(origin, r"/+\z", ""), F.lit("/"), F.regexp_replace(path, r"^/+", ""))


def content_path(file: Column, marker: str = "src/content/") -> Column:
    """What follows the content folder in a file's path, backslashes as slashes; null outside it."""
    parts = F.split(F.replace(file, F.lit("\\"), F.lit("/")), marker)
    return F.get(parts, 1)
