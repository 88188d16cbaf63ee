"""Plain versions of what the operators compute, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def in_fold(doc_id, modulus, remainder):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def simhash(text, width=3):
    w = WORD.findall(fold(text))
    shingles = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def classes(values, radius):
    """Smallest index reachable through values that differ in at most ``radius`` bits."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def quality(text):
    w = WORD.findall(text or "")
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def without_repeats(texts, length):
    """(bytes, removed, runs, sha256 of the rest) of every text."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def exact_repeats(rows, n=50):
    """Per doc_id the word positions inside runs of n words that a document of lower id has as well."""
    first, found = {}, collections.defaultdict(set)
    for i, text in sorted(rows):
        w = WORD.findall(fold(text))
        own = [tuple(w[k:k + n]) for k in range(len(w) - n + 1)]
        for k, g in enumerate(own):
            if g in first:
                found[i].update(range(k, k + n))
        for g in own:
            first.setdefault(g, i)
    return found


def base_scores(rows):
    """(tokens, known, N, base score) by doc_id, learned from crc32 mod 10 != 0."""
    tokens = [(i, [*WORD.findall(fold(t)), None]) for i, t in rows]
    count = collections.Counter(w for i, t in tokens if not in_fold(i, 10, 0) for w in t)
    n, v = sum(count.values()), len(count)
    return {i: (len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tokens}
