"""Small documents with what the operators must bear, and brute-force versions of the contracts."""

import hashlib
import random
import re

import numpy as np
import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, key string, n_lines string, spans string"


def documents(seed=1, n=60):
    """Prose with copies, near copies, shared lines and passages; null, empty, blank, unbroken and long texts; repeated rows and extra columns with clashing names."""
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "EPS", "zeta", "η", "theta,", "iota.", "kappa"] + [f"w{i}" for i in range(200)]
    passage = " ".join(r.choice(words) for _ in range(90))
    line = "A line that many of the documents share, again."
    out = {}
    for i in range(n):
        body = [" ".join(r.choice(words) for _ in range(r.randint(3, 40))) for _ in range(r.randint(1, 6))]
        if i % 4 == 0:
            body.insert(r.randint(0, len(body)), f"  {line.upper() if i % 8 else line} \t")
        if i % 5 == 0:
            body.insert(r.randint(0, len(body)), f"x {passage} y{i}")
        out[i] = "\n".join(body)
    for i in range(n, n + 12):
        out[i] = out[i % 7 + 3]
    for i in range(n + 12, n + 20):
        w = out[i % 5 + 10].split(" ")
        w[len(w) // 2] = f"edit{i}"
        out[i] = " ".join(w)
    out |= {200: None, 201: "", 202: " \n\t ", 203: "x" * 3000, 204: ("ab " * 700), 205: "\n\n", 206: "▁ mark  two ", 207: " ".join(words) * 30}
    return out


def frame(spark, docs, repeat=()):
    rows = [(i, t, "k", "n", "s") for i, t in docs.items()] + [(i, docs[i], "k", "n", "s") for i in repeat]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def line_dedup(docs, chars=20, least=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    holders = {}
    for i, t in docs.items():
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, []).append(i)
    bad = {k: max(v) for k, v in holders.items() if len(k) >= chars and len(v) >= least}
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if bad.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept).encode()))
    return out


def substring_dedup(docs, size=20):
    seen, out = set(), {}
    for i in sorted(docs):
        w = (docs[i] or "").encode().split()
        gone = bytearray(len(w))
        for s in range(len(w) - size + 1):
            t = tuple(w[s : s + size])
            if t in seen:
                gone[s : s + size] = b"\1" * size
            seen.add(t)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), sha(b" ".join(kept)))
    return out


def suffix_dedup(docs, size=400):
    count, out = {}, {}
    raw = {i: (t or "").encode() for i, t in docs.items()}
    for b in raw.values():
        for s in range(len(b) - size + 1):
            count[b[s : s + size]] = count.get(b[s : s + size], 0) + 1
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if count[b[s : s + size]] > 1:
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def simhash(docs, shingle=3, radius=3):
    fp = {}
    for i, t in docs.items():
        w = (t or "").translate(ASCII_LOWER).encode().split()
        s = [b" ".join(w[j : j + shingle]) for j in range(len(w) - shingle + 1)] if len(w) >= shingle else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return fp, components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= radius)


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(ids)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def decontaminate(docs, items, n=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(ASCII_LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    out = {}
    for i, t in docs.items():
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit |= set(range(s, s + k))
                    found |= windows[tuple(w[s : s + k])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def topk(rows, k):
    v = {i: np.floor(256 * np.array(x, np.float32).astype(np.float64)).astype(np.int64) for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)}
    out = {}
    for q in v:
        if q % 50 == 0:
            ranked = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:k]
            out |= {(q, r + 1): (c, -s) for r, (s, c) in enumerate(ranked)}
    return out
