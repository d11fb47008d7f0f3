"""Brute-force versions of the operators, over plain Python rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def components(ids, linked):
    """Smallest reachable id of each position, by union of the linked position pairs."""
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = top(a), top(b)
        if a != b:
            up[a] = b
    low = {}
    for i, x in enumerate(ids):
        low[top(i)] = min(low.get(top(i), x), x)
    return [low[top(i)] for i in range(len(ids))]


def simhash(text, shingle=3):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(docs, radius=2):
    fps = [simhash(t) for _, t in docs]
    x = np.array(fps, np.uint64)
    pairs = zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius)) if len(x) else ()
    return {(d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, components([d for d, _ in docs], pairs))}


def exact(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    return {(d, min(g), len(g), d == min(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for d in g}


def repeats(docs, length=100):
    seen, out = set(), set()
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.add((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def licences(docs):
    out = {}
    for d, t in docs:
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for label, p in BASE_PHRASES.items() for i in range(len(words))
              if words[i:i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        out[d] = (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
    return out


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
