"""Plain Python versions of the operators, for small tables."""

import hashlib
import itertools
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PII = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
       ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def jaccard_classes(docs, percent=80):
    sets = []
    for _, text in docs:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[top(k)] = min(low.get(top(k), i), i)
    return sorted(((i, len(sets[k]), low.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(docs)), key=str)


def overlap(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, found = ITEM_WORD.findall(lower(text)), set(), set()
        for item, t in items:
            x = ITEM_WORD.findall(lower(t))
            n = min(window, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s:s + n] == x[k:k + n]:
                        hit.update(range(s, s + n))
                        found.add(item)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PII):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    places = {}
    for k in range(len(w) - 4):
        places.setdefault(tuple(w[k:k + 5]), []).append(k)
    covered = {p + d for v in places.values() if len(v) > 1 for p in v for d in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle_leaf(values):
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def merkle_root(leaves, fanout, proofs):
    """Root of a list of digests; ``proofs``, one list of steps for each, gets (before, after) of every level."""
    level, above = list(leaves), [[k] for k in range(len(leaves))]
    while len(level) > 1:
        up, under = [], []
        for k in range(0, len(level), fanout):
            run = level[k:k + fanout]
            for j, members in enumerate(above[k:k + fanout]):
                for m in members:
                    proofs[m].append((run[:j], run[j + 1:]))
            up.append(_sha("".join(run)))
            under.append([m for members in above[k:k + fanout] for m in members])
        level, above = up, under
    return level[0]


def merkle(rows, fanout=8):
    """rows: (order, group, leaf). {row number: (subroot, root, proof digest, proof)}."""
    groups = {}
    for k, (order, group, leaf) in enumerate(rows):
        groups.setdefault(group, []).append((order is not None, order or 0, leaf, k))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    proofs, subroots = {k: [] for k in range(len(rows))}, []
    for g in names:
        members = [m[3] for m in sorted(groups[g])]
        found = [[] for _ in members]
        subroots.append(merkle_root([rows[m][2] for m in members], fanout, found))
        for m, p in zip(members, found):
            proofs[m] += p
    top = [[] for _ in names]
    root = merkle_root(subroots, fanout, top) if names else None
    out = {}
    for g, sub, p in zip(names, subroots, top):
        for *_, k in groups[g]:
            steps = proofs[k] + p
            out[k] = (sub, root, _sha("".join("".join(b) + "".join(a) for b, a in steps)), steps)
    return out


def hard_negatives(rows, modulus=100, n_pos=5, n_neg=10, low=30, high=90, scale=256):
    """rows: (vec_id, vector, label), label as it is used."""
    kept = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a, y in kept:
        if i % modulus:
            continue
        scored = sorted(((sum(p * q for p, q in zip(a, v)), j, z) for j, v, z in kept if j != i), key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == y][:n_pos]:
            window = [s for s in scored if s[2] != y and low * p <= 100 * s[0] <= high * p][:n_neg]
            out += [(i, j, k + 1, n, p, s) for k, (s, n, _) in enumerate(window)]
    return sorted(out)
