"""Plain single-machine versions of the operators, for small inputs."""

import hashlib
import math
import re
from fractions import Fraction
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near(docs):
    """{doc_id: (set size, smallest reachable id)} by comparing all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    pairs = {p for ds in where.values() for p in combinations(sorted(ds), 2)}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "((?ai:password|passwd|secret|token|api_?key))"))
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def secret_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def rule_base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def repeats(docs, span=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept bytes)}: every window looked up among all earlier ones."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            if w in seen:
                gone[i : i + span] = b"\x01" * span
            else:
                seen.add(w)
        spans = len([x for x in bytes(gone).split(b"\x00") if x])
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def vector_codes(rows):
    """(vec_id, code, error, label_error, digest) of (vec_id, vector, label) rows of one length, with Python's integers."""
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], la) for i, v, la in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // 8
    first = dict(sorted((i, v) for i, v, _ in kept))
    books = [[first[i][p * size : p * size + size] for i in sorted(first)[:16]] for p in range(8)]

    def at(v):
        out = []
        for p in range(8):
            far = [sum((a - b) ** 2 for a, b in zip(v[p * size : p * size + size], c)) for c in books[p]]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(6):
        found = [at(v) for _, v, _ in kept]
        for p in range(8):
            for e in range(len(books[p])):
                mine = [v[p * size : p * size + size] for f, (_, v, _) in zip(found, kept) if f[p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    fits = lambda x: x if x is not None and x < 2**63 else None
    coded = [(i, "".join(f"{e:02x}" for e, _ in at(v)), fits(sum(d for _, d in at(v))), la) for i, v, la in kept]
    sums = {}
    for _, _, e, la in coded:
        sums[la] = None if e is None or sums.get(la, 0) is None else sums.get(la, 0) + e
    return [(i, c, e, fits(sums[la]), digest) for i, c, e, la in coded]


def simhash_of(text):
    w = WORD.findall(lower(text or ""))
    hashes = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def simhash_groups(rows):
    """(id, fingerprint, smallest id reachable) of (id, fingerprint) rows by comparing all pairs."""
    fps = sorted({f for _, f in rows})
    top = {f: f for f in fps}

    def root(f):
        while top[f] != f:
            f = top[f]
        return f

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            top[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f"{f:016x}", least.get(root(f))) for i, f in rows]


def simhash(docs):
    return set(simhash_groups([(d, simhash_of(t)) for d, t in docs]))


def phrases(rows, top):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows: every phrase of up to four words counted."""
    count, n = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    count[key] = count.get(key, 0) + 1
    found = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= 30}
    inside = set()
    for (lang, p), a in found.items():
        inside |= {(lang, p[i:j]) for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * count[lang, p[i:j]]}
    best = {}
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            score, _, left, right = min((2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
            best.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, got in best.items() for i, (s, a, p, left, right) in enumerate(sorted(got)[:top]))
