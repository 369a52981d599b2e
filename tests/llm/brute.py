"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def base_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def shingles(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_components(rows, k=4):
    """{doc_id: (n, component)} by inverted index over shingles."""
    sets = {d: shingles(t, k) for d, t in rows}
    first, index = {}, defaultdict(list)
    for d in sorted(sets):
        first.setdefault(frozenset(sets[d]), d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def link(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for d, s in sets.items():
        if s and first[frozenset(s)] != d:
            link(d, first[frozenset(s)])
    for s, d in first.items():
        seen = Counter(o for x in s for o in index[x])
        for o, n in seen.items():
            if 100 * n >= 80 * (len(s) + len(sets[o]) - n):
                link(d, o)
        for x in s:
            index[x].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


KINDS = (
    ("assign", re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base_spans(text):
    return [sorted((m.start(), k, m.end()) for m in pattern.finditer(text or "") if ok(m)) for k, (_, pattern, ok) in enumerate(KINDS)]


def base_listing(text):
    return ",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in sorted(x for spans in base_spans(text) for x in spans))


def byte_repeats(rows, size=50):
    """{doc_id: removed mask} of 50-byte strings that also start in a smaller document."""
    first, out = {}, {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first.get(b[i : i + size], d) < d:
                mask[i : i + size] = b"\1" * size
        for i in range(len(b) - size + 1):
            first.setdefault(b[i : i + size], d)
        out[d] = (b, mask)
    return out


def word_repeats(rows, size=20):
    """{doc_id: (words, removed mask)} of windows whose words also start earlier."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        mask = [False] * len(w)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                mask[i : i + size] = [True] * size
            seen.add(key)
        out[d] = (w, mask)
    return out


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
