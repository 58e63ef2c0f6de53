"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(AZ))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text)."""
    sets, parent, seen = [shingle_set(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for j, s in enumerate(sets):
        common = defaultdict(int)
        for f in s:
            for k in seen[f]:
                common[k] += 1
            seen[f].append(j)
        for k, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[k]) - n):
                parent[find(j)] = find(k)
    low = {}
    for j, (i, _) in enumerate(rows):
        low[find(j)] = min(i, low.get(find(j), i))
    return sorted((i, len(s), low[find(j)]) for j, ((i, _), s) in enumerate(zip(rows, sets)))


def cut_repeats(rows, window=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        cut = [False] * len(b)
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w in seen:
                cut[p : p + window] = [True] * window
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cut) if not c)
        out.append((i, len(b), sum(cut), sum(c and not (k and cut[k - 1]) for k, c in enumerate(cut)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def line_dedup(rows, min_words=50):
    """doc_id to the text without the lines of any run of at least min_words words that starts earlier too."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        words = [len(re.findall("[^\x20\x09-\x0d]+", x)) for x in lines]
        gone = set()
        for a in range(len(lines)):
            total, digest = 0, hashlib.sha256()
            for b in range(a, len(lines)):
                total += words[b]
                digest.update(lines[b].encode() + b"\n")
                if total >= min_words:
                    w = digest.digest()
                    if w in seen:
                        gone.update(range(a, b + 1))
                    seen.add(w)
        out[i] = text if text is None or not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def bench_words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(AZ)) if w]


def contaminated(docs, items):
    """doc_id of documents that hold a window of an item."""
    windows = defaultdict(set)
    for _, text in items:
        w = bench_words(text)
        n = min(len(w), 10)
        if n:
            windows[n] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    out = set()
    for i, text in docs:
        w = bench_words(text)
        if any(tuple(w[k : k + n]) in ws for n, ws in windows.items() for k in range(len(w) - n + 1)):
            out.add(i)
    return out
