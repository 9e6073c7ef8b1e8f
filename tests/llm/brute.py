"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def base_stats(text):
    text = text or ""
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def quality_rules(rows, line_docs=5, line_share=0.05, left=0.3):
    """rows: (doc_id, text, host)."""
    key = lambda line: line.strip(STRIP).lower()
    docs, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            if words(line):
                docs[host, key(line)].add(text)
    out = []
    for doc_id, text, host in rows:
        stats = base_stats(text)
        over = lambda line: len(docs[host, key(line)]) > max(line_docs, line_share * len(hosts[host]))  # noqa: B023, E731
        rest = sum(len(words(line)) for line in (text or "").split("\n") if words(line) and not over(line))
        out.append((doc_id, *stats, not stats[-1] and rest >= 20 and rest >= left * stats[0], rest))
    return out


def fingerprint(text):
    w = [x.translate(LOWER) for x in words(text)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    """ids in order; linked(i, j) for two of them. Returns the least id reachable by each."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def line_dedup(rows, min_docs=3, min_chars=20):
    """rows: (doc_id, text), ids distinct."""
    key = lambda line: line.strip(STRIP).translate(LOWER)
    docs = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            docs[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(k := key(x)) >= min_chars and len(docs[k]) >= min_docs and max(docs[k]) != doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def targets(sizes):
    """sizes: {source: words}. The targets by sharing out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = rest / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * share for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
            free.discard(s)
    return out


def exact_groups(rows):
    """rows: (doc_id, text). By row: keep_id, group_size, sha256."""
    norm = [(text or "").translate(LOWER) for _, text in rows]
    size, keep = Counter(norm), {}
    for (doc_id, _), t in zip(rows, norm, strict=True):
        keep[t] = max(keep.get(t, doc_id), doc_id)
    return [(d, keep[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for (d, _), t in zip(rows, norm, strict=True)]
