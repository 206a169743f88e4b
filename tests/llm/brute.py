"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def bucket(doc_id, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def components(n: int, links) -> list[int]:
    """For each of n items, the smallest item that links reach."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_vectors(rows: list[tuple[int, list | None]], least: float = 0.9) -> dict[int, tuple[int, int, bool]]:
    """vec_id to (n_links, component_id, kept); ids are distinct."""
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float64) / np.abs(v).max() if ok else None)
    norm = [None if x is None else float(np.sqrt((x * x).sum())) for x in unit]
    fine = [i for i in range(len(rows)) if unit[i] is not None]
    links = [(i, j) for i in fine for j in fine if j < i and len(unit[i]) == len(unit[j]) and float((unit[i] * unit[j]).sum()) / (norm[i] * norm[j]) >= least]
    count = Counter(x for link in links for x in link)
    group = defaultdict(list)
    for i, r in enumerate(components(len(rows), links)):
        group[r].append(i)
    out = {}
    for members in group.values():
        least_id = min(rows[i][0] for i in members)
        for i in members:
            out[rows[i][0]] = (count[i], least_id, rows[i][0] == least_id)
    return out


def dedup_words(rows: list[tuple[int | None, str | None]], window: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_removed, sha256 of what is kept) in the order of rows."""
    first: dict[tuple, int] = {}
    order = lambda d: (d is None, d or 0)
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k not in first or order(d) < first[k]:
                first[k] = order(d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(d):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(text: str | None) -> int:
    w = [x.encode() for x in words(lower(text))]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows: list[tuple[int, str | None]], radius: int = 3) -> dict[int, tuple[str, int]]:
    fp = [fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= radius]
    group = defaultdict(list)
    for i, r in enumerate(components(len(rows), links)):
        group[r].append(i)
    return {rows[i][0]: (f"{fp[i]:016x}", min(rows[j][0] for j in m)) for m in group.values() for i in m}


def quality(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = [False] * len(w)
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            again[i : i + 5] = [True] * 5
    r = sum(again)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, len(w) < 10 or 100 * r > 20 * len(w)


def base_scores(rows: list[tuple[int | None, str | None]]) -> dict:
    """(doc_id, text) rows to {doc_id: (n_tokens, n_known, train_tokens, base_score)}; tokens are words and an end."""
    toks = [(d, [*words(lower(t)), None]) for d, t in rows]
    c = Counter(x for d, t in toks if bucket(d, 5) != 1 for x in t)
    n, v = sum(c.values()), len(c)
    return {d: (len(t), sum(c[x] > 0 for x in t), n, sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for d, t in toks}
