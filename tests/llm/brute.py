"""Plain versions of what the operators compute, over lists of rows, to hold them against."""

import hashlib
import re

import numpy as np
import xxhash

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(number):
    d = [int(x) for x in number][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def pii(text):
    def ok(kind, hit):
        n = re.sub(r"\D", "", hit)
        return {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in hit.split(".")), "card": 14 <= len(n) <= 19 and luhn(n), "phone": 10 <= len(n) <= 15}[kind]

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if ok(kind, m[0]))


def fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words[i:i + size] for i in range(len(words) - size + 1)] if len(words) >= size else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode("utf-8", "surrogatepass"), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    """Component (smallest id) of each (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), k), k)
    return [least[root(i)] for i in range(len(prints))]


def repeats(rows):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49 if i is not None else 0):
            first[b[k:k + 50]] = min(first.get(b[k:k + 50], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def targets(sizes, weights=(1, 2, 3), cap=3):
    """{source: target}: shares by weight, cut at the cap, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, full = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        share = {s: (left - sum(full.values())) * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**full, **share}
        full.update((s, cap * sizes[s]) for s in over)


def nearest(ids, vectors, query, k=10):
    distance = np.sqrt(((vectors - vectors[list(ids).index(query)]) ** 2).sum(1))
    ranked = sorted((d, i) for d, i in zip(distance, ids) if i != query)
    return [i for _, i in ranked[:k]]
