"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A template is looked for in windows of one and a half times its shingles, which start at every word with a shingle of the
template, so one with words put in has a window of its own too. A window's signature is ``BANDS`` bands of ``ROWS`` minima
over its five-word shingles. The Jaccard similarity of a window that contains 0.8 of a template's shingles is at least 0.44,
and a band agrees with a probability of 1 - (1 - 0.44**2)**64, over 0.99999. Templates of
agreeing bands are verified: their distinct shingles that the window has, over all of them, must be at least ``LEAST``; the
span found is the shortest run of the window that has as many. A window without any shingle of any template can't agree in a
band, so no signature is computed for it.

The templates are a parameter, and small: what is broadcast is bounded by them and not by the documents.

Defined results: null and empty texts match nothing; a text of any length is read whole; of overlapping spans of one template the one
with the highest containment counts, then the shortest, then the first; a containment equal to the threshold reaches it; words are runs of letters and digits, A-Z in lower case; a template
under five words is one shingle of all its words and matches where they follow one another; equal templates each match;
rows of a repeated doc_id each get their row; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.shared import bound_arrow
from spanlens.llm.words import SPACE, Words, binary, mix, small_batches

U = np.uint64
SHINGLE = 5
BANDS = 64
ROWS = 2
LEAST = 0.8
SLACK = 1.5
BREAK = SPACE.copy()
BREAK[list(range(33, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 127))] = True
SALT = np.random.Generator(np.random.PCG64(23)).integers(1, 2**64 - 1, size=BANDS * ROWS, dtype=U)
TEMPLATES = {
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-text": "This work is licensed under a Creative Commons Attribution",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "all-rights-reserved": "All rights reserved.",
    "reserved": "Copyright. All rights reserved. No part of this may be reproduced",
}
MATCH = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))


class Templates:
    """Shingles, windows and bands of all templates."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.words = [Words([texts[k].encode()], lower=True, space=BREAK).hashes() for k in self.names]
        self.size = [len(w) for w in self.words]
        self.shingles: list[np.ndarray] = []
        self.by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if not len(w):
                self.shingles.append(np.empty(0, U))
                continue
            self.shingles.append(np.unique(shingles(w, self.width(i))))
            self.by_size.setdefault(self.size[i], []).append(i)
        self.known = {w: np.unique(np.concatenate([self.shingles[i] for i in range(len(self.names)) if self.size[i] and self.width(i) == w])) for w in {self.width(i) for i in range(len(self.names)) if self.size[i]}}
        self.band = {n: np.stack([bands(signature(shingles(self.words[i], self.width(i))[None, :]))[0] for i in own]) for n, own in self.by_size.items()}

    def width(self, i: int) -> int:
        return min(SHINGLE, self.size[i])


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of ``width`` word hashes."""
    if len(h) < width:
        return np.empty(0, U)
    out = np.zeros(len(h) - width + 1, U)
    for k in range(width):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return out


def signature(windows: np.ndarray) -> np.ndarray:
    """MinHash signatures of windows (windows x shingles)."""
    return np.stack([mix(windows ^ s).min(axis=1) for s in SALT], axis=1)


def bands(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), U)
    for k in range(ROWS):
        out = mix(out * U(0x9E3779B97F4A7C15) + sig[:, k::ROWS])
    return out


def shortest(window: np.ndarray, want: np.ndarray) -> tuple[int, int]:
    """First and last place of the shortest run of the window that has all the wanted shingles the window has."""
    at = np.flatnonzero(np.isin(window, want))
    need = len(np.unique(window[at]))
    best, seen, a = (0, len(window)), {}, 0
    for b in at.tolist():
        seen[int(window[b])] = seen.get(int(window[b]), 0) + 1
        while len(seen) == need:
            if b - at[a] < best[1] - best[0]:
                best = (int(at[a]), b)
            x = int(window[at[a]])
            seen[x] -= 1
            if not seen[x]:
                del seen[x]
            a += 1
    return best


def scan(t: Templates, texts: list[bytes | None], least: float = LEAST) -> list[list[dict]]:
    """For each text, the templates found in it with their code-point spans, in the order of their starts."""
    w = Words(texts, lower=True, space=BREAK)
    h = w.hashes()
    out: list[list[dict]] = [[] for _ in texts]
    own = {width: (s := shingles(h, width), np.flatnonzero(np.isin(s, known))) for width, known in t.known.items()}
    for size, members in t.by_size.items():
        width = min(SHINGLE, size)
        s, hit = own[width]
        span = size - width + 1
        wide = math.ceil(SLACK * span) if size > width else span
        if not len(hit):
            continue
        last = w.first[w.doc[hit] + 1] - width  # the last shingle of the text
        hit, last = hit[hit <= last], last[hit <= last]
        for a in range(0, len(hit), 4096):
            part = hit[a : a + 4096]
            at = part[:, None] + np.arange(wide)[None, :]
            windows = s[np.minimum(at, last[a : a + 4096, None])]  # at the end of a text its last shingle is repeated
            mine = bands(signature(windows))
            for row, i in zip(t.band[size], members, strict=True):
                near = np.flatnonzero((mine == row).any(axis=1))
                want = t.shingles[i]
                for k in near:
                    share = np.isin(want, windows[k]).mean()
                    if share >= least:
                        a0, e0 = shortest(windows[k], want)
                        first, e0 = int(part[k]) + a0, int(part[k]) + e0
                        d = int(w.doc[first])
                        out[d].append({"license": t.names[i], "first": first, "last": e0 + width - 1, "containment": float(share)})
    for d, found in enumerate(out):
        best: list[dict] = []
        for m in sorted(found, key=lambda m: (-m["containment"], m["last"] - m["first"], m["first"], m["license"])):
            if not any(b["license"] == m["license"] and m["first"] <= b["last"] and b["first"] <= m["last"] for b in best):
                best.append(m)
        for m in best:
            a, e = int(w.starts[m["first"]] - w.offset[d]), int(w.ends[m["last"]] - w.offset[d])
            m["start"] = len(texts[d][:a].decode(errors="ignore"))
            m["end"] = m["start"] + len(texts[d][a:e].decode(errors="ignore"))
            del m["first"], m["last"]
        out[d] = sorted(best, key=lambda m: (m["start"], m["license"]))
    return out


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, matches) of every row: matches are structs of license, start, end (code points) and containment."""
    bound_arrow(docs.sparkSession)
    t = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES))

    def run(batches):
        for batch in small_batches(batches):
            found = scan(t.value, binary(batch.column("text")), least)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, MATCH)], ["doc_id", "matches"])

    kind = "doc_id long, matches array<struct<license:string,start:int,end:int,containment:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def op7_license_minhash(spark, sf_dir: str) -> DataFrame:
    out = license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_join(F.array_sort(F.array_distinct("matches.license")), ",")
    return out.select("doc_id", names.alias("licenses"), F.array_max("matches.containment").alias("best_containment"))
