"""Incremental substring deduplication over a log-structured index of window fingerprints.

A batch of documents is cut into chunks of consecutive doc_ids. A chunk sends, to each bucket of fingerprints, its sorted
distinct window fingerprints as one packed row. A bucket merge-joins them with the sorted immutable runs that earlier
batches left and with the other chunks of the batch, and answers each chunk with one bit per fingerprint: whether the
window also starts in an earlier document. A fingerprint has 64 bits: 48 of one hash, of which the first name its bucket, and
16 of an independent one, modulo a prime, that verify a match of the others; texts of earlier batches are not kept, so
their words can't be compared again. Sorted fingerprints are stored as differences, of as many bytes as the largest one needs.
A batch then leaves its own sorted run, and ``compact`` merges runs of one level into one of the next. Runs lie in files by
bucket, so that a batch moves its own fingerprints and none of the index, however large that is.

Because a chunk sends a fingerprint once however often it occurs in it, a passage that a third of all documents share
costs a bucket one entry a chunk. No row is made for a window. Rows without an id, or of one id with very many rows, are
several chunks, among which none counts as earlier.

Defined results: a null text has no words and keeps nothing (empty text); texts under 13 words lose nothing; a text of any
length is read whole, as part of one chunk; documents of equal doc_id don't count as earlier than each other; a null doc_id
counts as after all others, and two of them don't count as earlier than each other; of equal passages the one in the smallest
doc_id stays, in all rows of that id; an empty table gives an empty table. Columns other than ``doc_id`` and ``text`` are
carried inside a struct, so that they may have any name.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlens.llm.shared import bound_arrow, lean_shuffles, stage_bucketed, text_bytes
from spanlens.llm.words import Words, binary, pack, prime_spans, prime_windows, trim, unpack

WINDOW = 13
CHUNK_BYTES = 8 << 20
MAX_CHUNKS = 8192
BUCKET = 1 << 18
MAX_BITS = 18
FANOUT = 4
U = np.uint64
MESSAGE = "bucket int, chunk int, rank int, n int, data binary"
ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("rank", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
RUN = -1


class ChunkWindows:
    """Windows of the documents of one chunk, in the order of doc_id."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], window: int, bits: int):
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        rank = np.zeros(len(ids), np.int64)
        for k, (i, j) in enumerate(zip(self.order, self.order[1:], strict=False), 1):
            rank[k] = rank[k - 1] + (ids[i] != ids[j])
        self.words = Words([texts[i] for i in self.order])
        self.window, self.shift = window, U(64 - bits)
        self.low = U((1 << (64 - bits)) - 1)
        e, self.at = self.words.windows(self.words.hashes(0), window, 0)
        e &= U(0xFFFFFFFFFFFF0000)
        w = self.words
        e |= prime_windows(prime_spans(w.raw, w.starts, w.ends), window)[self.at] & U(0xFFFF)
        self.at = self.at.astype(np.int32)
        by = np.argsort(e, kind="stable").astype(np.int32)
        e = e[by]
        head = np.ones(len(by), bool)
        head[1:] = e[1:] != e[:-1]
        self.entry = e[head]
        del e
        self.group = np.empty(len(by), np.int32)
        self.group[by] = np.cumsum(head, dtype=np.int32) - 1
        doc_rank = rank.astype(np.int32)[self.words.doc[self.at]]
        self.earlier_here = doc_rank > doc_rank[by[head]][self.group]
        del by, head, doc_rank
        bucket = self.bucket(self.entry)
        self.edges = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist(), len(bucket)] if len(bucket) else [0]

    def bucket(self, e: np.ndarray) -> np.ndarray:
        return (e >> self.shift).astype(np.int32) if self.shift < 64 else np.zeros(len(e), np.int32)

    def messages(self, chunk: int, rank: int) -> pa.Table:
        parts = [self.entry[a:b] for a, b in zip(self.edges, self.edges[1:], strict=False)]
        bucket = self.bucket(self.entry[self.edges[:-1]]).tolist()
        return table_of([(k, chunk, rank, len(p), pack(p & self.low)) for k, p in zip(bucket, parts, strict=True)])

    def removed(self, replies: dict[int, bytes]) -> np.ndarray:
        """For each word, whether a window that also starts in an earlier document covers it."""
        known = np.zeros(len(self.entry), bool)
        for k, a, b in zip(self.bucket(self.entry[self.edges[:-1]]).tolist(), self.edges, self.edges[1:], strict=False):
            bits = replies.get(k)
            if bits is not None:
                known[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        hit = self.at[self.earlier_here | known[self.group]]
        cover = np.zeros(len(self.words.doc) + 1, np.int32)
        cover[hit] += 1  # no window starts twice at a word
        cover[hit + self.window] -= 1
        return np.cumsum(cover[:-1], dtype=np.int32) > 0


def table_of(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[] for _ in ARROW]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, ARROW, strict=True)], schema=ARROW)


def _send(window: int, bits: int):
    def run(key, table):
        out = ChunkWindows(table.column("id").to_pylist(), binary(table.column("text")), window, bits).messages(key[0].as_py(), table.column("rank")[0].as_py())
        trim()
        return out

    return run


def _match(table, history):
    """The messages of one bucket and the runs of earlier batches, to bits for each chunk and the batch's own run.

    Chunks of one rank don't count as earlier than each other."""
    if not table.num_rows:
        return table_of([])
    bucket = table.column("bucket")[0].as_py()
    chunk, rank, n = (table.column(c).to_numpy() for c in ("chunk", "rank", "n"))
    data = table.column("data").to_pylist()
    new = np.argsort(rank, kind="stable").tolist()
    e = np.concatenate([unpack(n[i], data[i]) for i in new])
    of = np.repeat(rank[new], n[new])
    by = np.argsort(e, kind="stable")
    head = np.ones(len(e), bool)
    head[1:] = e[by[1:]] != e[by[:-1]]
    run = e[by[head]]
    same = np.empty(len(e), bool)
    same[by] = of[by] > of[by[head]][np.cumsum(head) - 1]
    if history is not None:
        for m, old in zip(history.column("n").to_pylist(), history.column("data").to_pylist(), strict=True):
            old = unpack(m, old)
            same |= old[np.minimum(np.searchsorted(old, e), len(old) - 1)] == e
    out, a = [], 0
    for i in new:
        if (own := same[a : a + n[i]]).any():
            out.append((bucket, int(chunk[i]), 0, int(n[i]), np.packbits(own).tobytes()))
        a += n[i]
    out.append((bucket, RUN, 0, len(run), pack(run)))
    return table_of(out)


def _match_first(table):
    return _match(table, None)


def _merge(table):
    """Runs of one bucket as one."""
    e = np.unique(np.concatenate([unpack(n, d) for n, d in zip(table.column("n").to_pylist(), table.column("data").to_pylist(), strict=False)]))
    return table_of([(table.column("bucket")[0].as_py(), RUN, 0, len(e), pack(e))])


def _finish(window: int, bits: int, schema: pa.Schema):
    def run(left, right):
        ids, texts = left.column("id").to_pylist(), binary(left.column("text"))
        c = ChunkWindows(ids, texts, window, bits)
        gone = c.removed(dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=False)))
        first, n, kept, spans = c.words.first, c.words.n, [], []
        lost = np.zeros(len(ids), np.int64)
        for k, i in enumerate(c.order):
            own = gone[first[k] : first[k + 1]]
            words = (texts[i] or b"").split()
            lost[k] = own.sum()
            if lost[k]:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=False)])
                words = [w for w, x in zip(words, own.tolist(), strict=False) if not x]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        rest = left.column("rest").combine_chunks().take(pa.array(c.order, pa.int64())) if len(ids) else left.column("rest").combine_chunks()
        text = left.column("text").combine_chunks().take(pa.array(c.order, pa.int64()))
        del c, gone
        trim()
        cols = [rest, text, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, schema.field("removed").type)]
        return pa.table(cols, names=schema.names)

    return run


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class WindowIndex:
    """Runs of window fingerprints of the documents seen so far; ``add`` deduplicates a batch against them and itself."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, bits: int = 11, fanout: int = FANOUT):
        """``bits``: the index has 2**bits buckets, 2**``MAX_BITS`` at most; its files are as many as shuffles have partitions."""
        self.spark, self.window, self.bits, self.fanout = spark, window, min(MAX_BITS, max(0, bits)), fanout
        self.files = min(1 << self.bits, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[tuple[int, DataFrame]] = []
        self.compactions = 0

    def history(self) -> DataFrame | None:
        out = None
        for _, run in self.runs:
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, docs: DataFrame, ranges: Ranges, append: bool = True) -> DataFrame:
        """One row per row of ``docs``: rest (struct of its other columns), text, n_words, n_removed, kept_text, removed (word spans).

        ``ranges`` cut the batch into chunks. Ids must not lie before those of earlier batches. With ``append``, the batch
        leaves its run for later batches."""
        bound_arrow(self.spark)
        rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
        id_ = F.col("doc_id").cast("long")
        dealt = docs.select(*ranges.columns(id_, F.col("text")), id_.alias("id"), "text", rest)
        sent = dealt.groupBy("chunk").applyInArrow(_send(self.window, self.bits), MESSAGE)
        if (old := self.history()) is None:
            replies = sent.groupBy("bucket").applyInArrow(_match_first, MESSAGE)
        else:
            replies = sent.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(_match, MESSAGE)
        if append:
            with lean_shuffles(self.spark):
                replies = stage_bucketed(replies, "window-replies", "bucket", self.files)
            self.runs.append((0, replies.where(F.col("chunk") == RUN)))
            self.compact()
        long, no = F.lit(0).cast("long"), F.lit(None)
        shape = dealt.select("rest", "text", long.alias("n_words"), long.alias("n_removed"), F.lit("").alias("kept_text"), no.cast("array<struct<start:int,end:int>>").alias("removed"))
        kind = T.StructType([T.StructField(f.name, f.dataType) for f in shape.schema])
        arrow = pa.schema([("rest", pa.null()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", SPANS)])
        answers = replies.where(F.col("chunk") >= 0).select(F.col("chunk").alias("to"), "bucket", "data")
        return dealt.drop("rank").groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(_finish(self.window, self.bits, arrow), kind)

    def compact(self) -> None:
        """Merges the runs of a level into one of the next, once there are ``fanout`` of them; runs stay where they are by bucket."""
        level = 0
        while (same := [r for k, r in self.runs if k == level]) and len(same) >= self.fanout:
            rows = same[0]
            for r in same[1:]:
                rows = rows.unionByName(r)
            merged = stage_bucketed(rows.groupBy("bucket").applyInArrow(_merge, MESSAGE), "window-run", "bucket", self.files)
            self.runs = [(k, r) for k, r in self.runs if k != level] + [(level + 1, merged)]
            self.compactions += 1
            level += 1


class Ranges:
    """Ranges of doc_ids and, for each, the number of its chunks: one, but for a range that is a single id with many rows, and
    for rows without an id, which come last."""

    def __init__(self, bounds: list[int], parts: list[int]):
        self.bounds, self.parts = bounds, parts

    def columns(self, key: Column, text: Column) -> list[Column]:
        """``rank``, the number of the range, and ``chunk``."""
        at = F.when(key.isNull(), F.lit(len(self.bounds) + 1)).otherwise(chunk_of(key, self.bounds)).cast("int")
        if max(self.parts) == 1:
            return [at.alias("chunk"), at.alias("rank")]
        first = [sum(self.parts[:k]) for k in range(len(self.parts))]
        of = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), at + 1)
        return [(of(first) + F.pmod(F.xxhash64(text), of(self.parts))).cast("int").alias("chunk"), at.alias("rank")]


def chunk_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds that are not above the key, found in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*(F.lit(int(b)).cast("long") for b in bounds[::step]))
    fine = F.array(*(F.lit(int(b)).cast("long") for b in bounds))
    at = F.size(F.filter(coarse, lambda b: b <= key))
    found = F.element_at(
        F.transform(F.array(at), lambda k: F.when(k == 0, F.lit(0)).otherwise((k - 1) * step + F.size(F.filter(F.slice(fine, (k - 1) * step + 1, step), lambda b: b <= key)))), 1
    )
    return found.cast("int")


def quantiles(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 doc_ids that cut the table into n parts of about as many rows; an id of several parts repeats."""
    if n <= 1:
        return []
    return docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 20 * n)).first()[0] or []


def ranges(docs: DataFrame, n: int) -> Ranges:
    """About n chunks of about as many rows."""
    if n <= 1:
        return Ranges([], [1, 1])
    id_ = F.col("doc_id").cast("long")
    rows, ids = docs.select(F.count(F.lit(1)), F.count(id_)).first()
    own = max(1, round(n * ids / rows)) if rows else 1
    times = Counter(quantiles(docs.where(id_.isNotNull()), own))
    hot = {d: k for d, k in times.items() if k > 1}  # over a part's rows each
    bounds = sorted(set(times) | {d + 1 for d in hot if d < 2**63 - 1})
    return Ranges(bounds, [1] + [hot.get(b, 1) for b in bounds] + [max(1, n - own)])


def substring_dedup(docs: DataFrame, window: int = WINDOW, first: float = 0.2, chunk_bytes: int = CHUNK_BYTES, index: WindowIndex | None = None) -> DataFrame:
    """Deduplicates a table that is there as a whole in batches of rising doc_id: a first share of the rows in as many batches
    as make a compaction, then the rest, in batches of at most ``MAX_CHUNKS`` chunks, against the compacted run."""
    total = text_bytes(docs)
    chunks = max(1, math.ceil(total / chunk_bytes))
    bits = max(0, math.ceil(math.log2(max(1, total / 6 / BUCKET))))
    index = index or WindowIndex(docs.sparkSession, window, bits)
    more = max(1, math.ceil(chunks * (1 - first) / MAX_CHUNKS))
    shares = [first / index.fanout] * index.fanout + [(1 - first) / more] * more
    id_ = F.col("doc_id").cast("long")
    ends = [sum(shares[: k + 1]) for k in range(len(shares) - 1)]
    cuts = sorted(set(docs.select(F.percentile_approx(id_, ends, 20 * len(shares) * index.fanout)).first()[0] or []))
    out = None
    for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        batch = docs if a is None else docs.where((id_ >= a) | id_.isNull()) if b is None else docs.where(id_ >= a)
        batch = batch if b is None else batch.where(id_ < b)
        part = index.add(batch, ranges(batch, max(1, math.ceil(chunks * shares[min(k, len(shares) - 1)]))), append=b is not None)
        out = part if out is None else out.unionByName(part)
    return out


def op5_substring_lsm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("rest.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with repeated passages cut out of ``text`` (and ``n_chars`` to match); documents of which nothing is left go."""
    out = substring_dedup(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    own = {"text": text, "n_chars": F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("rest.n_chars")) if "n_chars" in docs.columns else None}
    return out.where(~changed | (F.col("n_removed") < F.col("n_words"))).select(*(own[c].alias(c) if own.get(c) is not None else F.col(f"rest.`{c}`") for c in docs.columns))
