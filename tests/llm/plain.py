"""The stages of the pipeline in plain Python, written apart from the library: slow, whole, and without its functions."""

from collections import Counter

import regex

SPACE = "\t\n\x0b\x0c\r "
ENDS = ".!?…:;。！？"
PHRASES = [
    "all rights reserved", "licensed under", "released under the", "is licensed under", "terms of use", "privacy policy", "cookie policy",
    "lorem ipsum", "click here", "sign up for", "subscribe to our", "share this", "javascript is disabled",
]


def words(text):
    return [w for w in regex.split("[\x20\x09-\x0d]+", text or "") if w]


def line_stays(line):
    w = words(line)
    if not w:
        return True
    line = " ".join(w)
    symbols = sum(c in "#*$%&|<>" for c in line)
    letters, capitals = len(regex.findall(r"\p{L}", line)), len(regex.findall(r"\p{Lu}", line))
    if line.count("|") >= 2 and line.count("|") > 0.2 * len(w) or symbols > 0.2 * len(w):
        return False
    if letters >= 8 and capitals > 0.6 * letters or any(p in line.lower() for p in PHRASES):
        return False
    end = line
    while end and (end[-1] in "\"'»”’)]" or end[-1].isspace()):
        end = end[:-1]
    return len(w) >= 10 or line[-1] in ENDS or end[-1:] in tuple(ENDS)


def clean(text):
    """The text without the lines that fail; None if the document is rejected."""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    again = {k for i, g in enumerate(windows) if often[g] > 1 for k in (i, i + 1, i + 2)}
    if len(w) < 50 or 100 * len(again) > 50 * len(w):
        return None
    lines = text.split("\n")
    left = [x for x in lines if line_stays(x)]
    return "\n".join(left) if sum(map(len, left)) >= 0.5 * sum(map(len, lines)) else None


def shingles(text, n=5):
    w = words((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def first_of_similar(rows, similar=(4, 5)):
    """Of rows (id, text) those that no chain of similar pairs joins to an earlier one, repeated rows once."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    w = [words(ascii_lower(t)) for _, t in rows]
    sets = [{" ".join(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for x in w]
    have = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            have.setdefault(x, []).append(i)
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s or {None} for j in have[x] if j < i}:
            both = len(s & sets[j])
            if similar[1] * both >= similar[0] * (len(s) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [r for i, r in enumerate(rows) if top(i) == i]


def units(text, level="line"):
    """(start, end, key, kind): lines or paragraphs, and the sentences of those that hold several."""
    out, at = [], 0
    if level == "line":
        pieces = [(0, x) for x in (text or "").split("\n")]
        starts, n = [], 0
        for _, x in pieces:
            starts.append((n, x))
            n += len(x) + 1
    else:
        starts, at = [], 0
        for m in regex.finditer(r"\n[ \t\r\f\v]*\n", text or ""):
            starts.append((at, text[at : m.start()]))
            at = m.end()
        starts.append((at, (text or "")[at:]))
    for start, piece in starts:
        if not piece.split():
            continue
        cuts, i = [0], 0
        while i < len(piece):
            if piece[i] in ".!?":
                while i < len(piece) and piece[i] in ".!?":
                    i += 1
                while i < len(piece) and piece[i].isspace():
                    i += 1
                cuts.append(i)
            else:
                i += 1
        if cuts[-1] != len(piece):
            cuts.append(len(piece))
        said = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if piece[a:b].split()]
        key = " ".join(piece.lower().split())
        out.append((start, start + len(piece), ("line", key), "parent" if len(said) > 1 else "line"))
        if len(said) > 1:
            for a, b in said:
                w = piece[a:b].lower().split()
                out.append((start + a, start + b, ("sentence", " ".join(w)), "sentence" if len(w) >= 6 else "short"))
    return out


def cut_units(rows, level="line"):
    """For rows (id, text), in order of id and text: the characters that go, a set of places for each."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        found, gone, again = units(text, level), set(), []
        for a, b, key, kind in found:
            again.append(key in seen)
            seen.add(key)
            if again[-1] and kind != "short":
                gone |= set(range(a, b))
        atoms = [(a, b, r) for (a, b, _, kind), r in zip(found, again, strict=True) if kind != "parent"]
        for _ in atoms:
            for (a, b, r), (c, d, s) in zip(atoms, atoms[1:], strict=False):
                if r and s and (a in gone or c in gone):
                    gone |= set(range(a, b)) | set(range(c, d))
        out.append((text, gone))
    return out
