"""The contracts once more, in plain Python and without any of the operators' code."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, kind=WORD):
    return kind.findall((text or "").translate(LOWER))


def repeats(rows, length=200):
    """op1: sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256)"""
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(raw[k : k + length] for _, raw in raws for k in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def base_places(text, phrases):
    """op2: (n_words, n_base, first, last, base labels)"""
    w, at, labels = words(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def fingerprint(text, width=3, seed=42):
    w = words(text, BLANK)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def simhash(rows, radius=2):
    """op3: (doc_id, fingerprint, component_id)"""
    prints = [fingerprint(t) for _, t in rows]
    roots = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius])
    least = defaultdict(list)
    for (i, _), r in zip(rows, roots):
        least[r].append(i)
    smallest = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return [(i, f"{p:016x}", smallest[r]) for (i, _), p, r in zip(rows, prints, roots)]


def contamination(rows, items, window=10):
    """op4: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)"""
    wanted = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wanted[tuple(w[k : k + n])].add(item)
    sizes = {len(x) for x in wanted}
    out = []
    for i, text in rows:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wanted:
                    hit.update(range(k, k + n))
                    found |= wanted[x]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def jaccard(a, b, width=5):
    def shingles(t):
        w = words(t, BLANK)
        return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return target | {s: float(cap * sizes[s]) for s in capped}
        capped.update(over)
