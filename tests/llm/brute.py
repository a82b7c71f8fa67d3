"""Plain, slow versions of the operators, for comparison on small tables."""

from collections import defaultdict

import regex

from marginalia.llm import decontaminate as d

SPLIT = regex.compile(r"[ \t\n\x0b\f\r]+")


def spaced(text):
    return regex.sub(f"([{d.DENSE.replace(chr(92) + 'x{20000}', chr(0x20000)).replace(chr(92) + 'x{2fa1f}', chr(0x2FA1F))}])", r" \1 ", regex.sub("[-]", " ", text or ""))


def template(text, names):
    """The words of a text; capitalised ones are names or literal words."""
    c = regex.sub(r"[0-9]+(?:[.,:/][0-9]+)*", d.NUMBER, spaced(text))
    c = regex.sub(rf"{d.NUMBER}( ?)(?i:{d.UNITS})(?![\p{{L}}{d.NUMBER}])", rf"{d.NUMBER}\1{d.UNIT}", c)
    out = []
    for w in SPLIT.split(c):
        first = next((i for i, x in enumerate(w) if x not in "\"'`«»‘’‚‛“”„‟([{<*_#"), len(w))
        capital = first <= 3 and first < len(w) and regex.match(r"\p{Lu}", w[first])
        left = regex.sub(rf"[^\p{{L}}\p{{M}}{d.NUMBER}{d.UNIT}]", "", w).lower()
        if left or capital:
            out.append(d.NAME if capital and names else left)
    return out


def values(text):
    return [w for w in (regex.sub(r"[^\p{L}\p{M}0-9]", "", x).lower() for x in SPLIT.split(spaced(text))) if w]


def windows(words, size=d.WINDOW):
    """Every window, or all words if they are fewer."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def placed(window):
    return [j for j, w in enumerate(window) if any(x in w for x in (d.NUMBER, d.UNIT, d.NAME))]


def literals(window):
    return sum(not regex.fullmatch(f"[{d.NUMBER}{d.UNIT}{d.NAME}]+", w) for w in window)


def holds(text, item, least=d.LEAST):
    """Whether a text holds a benchmark item, by the definition: enough windows, and consistent slots on one alignment."""
    t, l, v = template(item, True), template(item, False), values(item)
    if not t:
        return False
    size = min(d.WINDOW, len(t))
    docs = [template(text, True), template(text, False), values(text)]
    have = []
    for words in docs:
        at = defaultdict(list)
        for i, w in enumerate(windows(words, size) if len(words) >= size else []):
            at[w].append(i)
        have.append(at)
    wt, wl, wv = windows(t, size), windows(l, size), windows(v, size)
    counts = [literals(w) >= min(d.LITERALS, size) for w in wt]
    if any(counts):
        wanted = {wt[q] for q in range(len(wt)) if counts[q]}
        seen, slots = set(), defaultdict(set)
        for q in range(len(wt)):
            for form in (wt, wl):
                if counts[q] and literals(form[q]) >= min(d.LITERALS, size):
                    for at in {p for h in have for p in h.get(form[q], ())}:
                        seen.add(wt[q])
                        for j in placed(form[q]):
                            slots[at - q].add((v[q + j], docs[2][at + j]))
    else:
        wanted, seen, slots = set(wv), {w for w in wv if any(w in h for h in have)}, {}
    if not wanted or len(seen) / len(wanted) < least:
        return False
    shares = []
    for pairs in slots.values():
        by = defaultdict(set)
        for theirs, ours in pairs:
            by[theirs].add(ours)
        shares.append(sum(len(x) == 1 for x in by.values()) / len(by))
    return not shares or max(shares) >= least


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_copies(rows, least=0.8):
    """Ids (with texts) that aren't the smallest of their group; texts without words, and rows without an id, are in none."""
    own = [(i, t, shingles(t)) for i, t in rows if i is not None and shingles(t)]
    up = list(range(len(own)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            both = len(own[a][2] & own[b][2])
            if both / (len(own[a][2]) + len(own[b][2]) - both) >= least:
                up[find(a)] = find(b)
    first = {}
    for k, (i, _, _) in enumerate(own):
        first[find(k)] = min(first.get(find(k), i), i)
    return {(i, t) for k, (i, t, _) in enumerate(own) if first[find(k)] != i}
