"""Plain Python versions of the operators, for small tables."""

import hashlib
import re

import numpy as np

sha = lambda b: hashlib.sha256(b).hexdigest()


def neighbours(rows, k=20):
    """rows: (vec_id, vector); {(query, rank): (vec, score)}"""
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    out = {}
    for q, x in good.items():
        if q % 20 == 0:
            near = sorted((-float(x @ y), i) for i, y in good.items() if i != q and len(y) == len(x))
            out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(near[:k])}
    return out


def words10(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def contamination(docs, items, n=13):
    """docs: (id, text), items: (id, text); rows as the query gives them"""
    at = {}
    for i, t in items:
        w = words10(t)
        for s in range(max(1, len(w) - n + 1)) if w else ():
            at.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    sizes = {len(w) for w in at}
    out = []
    for d, t in docs:
        w, hit, found = words10(t), set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if got := at.get(tuple(w[s : s + m])):
                    found |= got
                    hit.update(range(s, s + m))
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def repeats(docs, size=100):
    """docs: (id, text) in order; id -> (bytes, removed, spans, digest of the rest)"""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - size + 1):
            x = b[s : s + size]
            if x in seen:
                gone[s : s + size] = True
            seen.add(x)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(kept)))
    return out


def shingles4(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def near(docs):
    """docs: (id, text); rows (id, n_shingles, component, kept)"""
    s = {d: shingles4(t) for d, t in docs}
    ids = sorted(s)
    of = {d: d for d in ids}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    by = {}
    for d in ids:
        for g in s[d]:
            by.setdefault(g, []).append(d)
    for a in ids:
        for b in {b for g in s[a] for b in by[g] if b > a}:
            x, y = root(a), root(b)
            if x != y and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                of[max(x, y)] = min(x, y)
    return [(d, len(s[d]), root(d), root(d) == d) for d in ids]
