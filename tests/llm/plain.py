"""Plain versions of the operators, one document at a time, to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(runs)
    inside = {j for i, r in enumerate(runs) if seen[r] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "base_failed": n < 20 or 100 * len(inside) > 30 * n,
    }


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs):
    """{doc_id: (n_shingles, component)} for (doc_id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    shared = Counter(p for ids in where.values() for p in combinations(sorted(ids), 2))
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    low = components(sets, links)
    return {i: (len(s), low[i]) for i, s in sets.items()}


def repeated_bytes(texts, size=400):
    """Per text: bytes, removed, spans, digest of the rest."""
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in blobs for i in range(len(b) - size + 1))
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(docs, benchmark):
    windows = defaultdict(set)
    for item, text in benchmark:
        words = PLAIN.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows[tuple(words[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        words = PLAIN.findall((text or "").translate(LOWER))
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                found = windows.get(tuple(words[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        names = ",".join(sorted(map(str, items)))
        out.append((doc_id, len(words), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def lines(docs, edits, least):
    """{doc_id: (distinct lines, repeated, characters kept)} for distinct ids."""
    white = " \t\n\x0b\x0c\r"
    per_doc, first = {}, {}
    for doc_id, text in sorted(docs):
        mine = list(dict.fromkeys(x for x in (y.strip(white) for y in (text or "").split("\n")) if x))
        per_doc[doc_id] = mine
        for at, line in enumerate(mine):
            first.setdefault(line, (doc_id, at))
    by_length = defaultdict(list)
    for line in first:
        if len(line) >= least:
            by_length[len(line)].append(line)
    later = set()
    for length, some in by_length.items():
        near = [x for k in range(length, length + edits + 1) for x in by_length.get(k, ())]
        for a in some:
            for b in near:
                if a != b and distance(a, b) <= edits:
                    later.add(max(a, b, key=first.get))
    out = {}
    for doc_id, mine in per_doc.items():
        gone = [x for x in mine if x in later or first[x][0] != doc_id]
        out[doc_id] = (len(mine), len(gone), sum(map(len, mine)) - sum(map(len, gone)))
    return out


PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def licenses(text):
    words = PLAIN.findall((text or "").translate(LOWER))
    found = sorted(
        (i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
    )
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def notices(texts, templates, contained):
    """{(number, label, score)} of templates that a line or a window over lines holds."""
    found = set()
    for i, text in enumerate(texts):
        every = (text or "").split()
        for label, notice in templates:
            sequence = notice.split()
            known = set(sequence)
            blocks = [line.split() for line in (text or "").split("\n")]
            blocks += [every[k : k + 2 * len(sequence)] for k in range(0, len(every), max(1, len(sequence) // 2))]
            best = max(len(known & set(block)) for block in blocks)
            if best >= contained * len(known) - 1e-9:
                found.add((i, label, round(best / len(known), 9)))
    return found
