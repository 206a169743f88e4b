"""Packing documents into sequences by non-negative least squares over length combinations.

A document's ids are cut into full windows and a remainder. Remainders are counted by length class (``STEP`` ids wide).
Combinations of up to four classes that fill a window exactly are the columns of a matrix; non-negative least squares
finds how often to use each so that the histogram of remainders is met, and the counts are rounded down. Remainders are
numbered within their class and dealt to the combinations' slots in that order. What no combination takes is laid end to
end and cut at the window; the last ids of such a lane go to sequences whose lengths are powers of two.

The driver sees the histogram of length classes, never documents. Texts are tokenized once: the ids of remainders are kept,
in two bytes each where the vocabulary allows, for those that are cut.

Tokens: ids of the tokenizer file, which has ids of its own for strings of special tokens in a text, then ``END``. The
tokenizer drops white space and never joins across it, so that pieces of words are tokenized one by one: each distinct
piece of a slice of texts once, and not again while a worker remembers it (``CACHE_BYTES``).

Defined results: a null or empty text is the one id ``END``; a text of any length is read in slices, and whole; rows of a
repeated doc_id are documents of their own, and pieces of equal length are dealt in the order of the rows; a null doc_id
stays null; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.llm.shared import bound_arrow, stage
from spanlens.llm.words import LOWER, Words, binary, hash_spans, lookup, small_batches

LENGTH = 2048
STEP = 8
END = 1
#: Bytes of texts that are tokenized at once, of the pieces a worker remembers, and of the longest of these.
SLICE = 1 << 20
CACHE_BYTES = 32 << 20
LONGEST = 64
LANE = 1 << 20
#: Rows of one length class that are numbered together, and into how many such groups a class is dealt at most.
SHARD = 100
MAX_SHARDS = 4096
_TOKENIZERS: dict[str, WordIds] = {}
BLANK, LETTER, DIGIT, REST, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[33:127] = REST
KIND[39] = ODD  # an apostrophe can begin a contraction
KIND[97:123] = LETTER
KIND[48:58] = DIGIT
KIND[[9, 10, 11, 12, 13, 32]] = BLANK
SPACES = re.compile(rb"[\x20\x09-\x0D]")


def gathered(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of an array, end to end."""
    kind = np.int32 if len(data) < 1 << 31 and size.sum() < 1 << 31 else np.int64
    size = size.astype(kind)
    return data[np.arange(int(size.sum()), dtype=kind) + np.repeat(starts.astype(kind) - (np.cumsum(size, dtype=kind) - size), size)]


class Pieces:
    """Pieces of text and their ids in flat arrays, by the sorted hashes of the pieces; of at most about ``limit`` bytes.

    What was looked up longest ago is forgotten first, by halves."""

    def __init__(self, limit: int, kind: str):
        self.limit, self.now = limit, 0
        self.key = np.empty(0, np.uint64)
        self.used = self.text_at = self.text_size = self.ids_at = self.ids_size = np.empty(0, np.int32)
        self.text, self.ids = np.empty(0, np.uint8), np.empty(0, kind)

    def find(self, key: np.ndarray, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where the pieces are, by hash and bytes; -1 for unknown ones."""
        self.now += 1
        at = lookup(self.key, key)
        own = np.flatnonzero(at >= 0)
        own = own[self.text_size[at[own]] == size[own]]
        same = gathered(raw, starts[own], size[own]) == gathered(self.text, self.text_at[at[own]], size[own])
        good = np.logical_and.reduceat(same, np.cumsum(size[own]) - size[own]) if len(own) else np.empty(0, bool)
        out = np.full(len(key), -1, np.int64)
        out[own[good]] = at[own[good]]
        self.used[out[out >= 0]] = self.now
        return out

    def add(self, key: np.ndarray, raw: np.ndarray, starts: np.ndarray, size: np.ndarray, ids: np.ndarray, ids_size: np.ndarray) -> None:
        """Adds pieces by sorted hashes; hashes that are there already stay as they are."""
        on = (lookup(self.key, key) < 0) & (size <= LONGEST)
        ids, ids_at = gathered(ids, (np.cumsum(ids_size) - ids_size)[on], ids_size[on]), len(self.ids)
        key, starts, size, ids_size = key[on], starts[on], size[on], ids_size[on]
        to = np.searchsorted(self.key, key)
        new = (np.full(len(key), self.now), len(self.text) + np.cumsum(size) - size, size, ids_at + np.cumsum(ids_size) - ids_size, ids_size)
        old = (self.used, self.text_at, self.text_size, self.ids_at, self.ids_size)
        self.used, self.text_at, self.text_size, self.ids_at, self.ids_size = (np.insert(o, to, n.astype(np.int32)) for o, n in zip(old, new, strict=True))
        self.key = np.insert(self.key, to, key)
        self.text, self.ids = np.concatenate([self.text, gathered(raw, starts, size)]), np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        if 28 * len(self.key) + self.text.nbytes + self.ids.nbytes > self.limit:
            keep = np.flatnonzero(self.used > np.median(self.used))
            self.text, self.ids = gathered(self.text, self.text_at[keep], self.text_size[keep]), gathered(self.ids, self.ids_at[keep], self.ids_size[keep])
            self.key, self.used, self.text_size, self.ids_size = self.key[keep], self.used[keep], self.text_size[keep], self.ids_size[keep]
            self.text_at, self.ids_at = ((np.cumsum(n) - n).astype(np.int32) for n in (self.text_size, self.ids_size))


class WordIds:
    """Ids of whole texts. A text falls into pieces that are tokenized on their own: odd words, and in words of
    ASCII and Latin-1 letters runs of letters (A-Z and those of Latin-1, in lower case), single digits, and runs of the rest."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = str.maketrans({c: byte_level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))})
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        probe = "a thing 7 !? über çaé ñandú".split()
        self.direct = all(self.of_model(x) == self.encode(x) for x in probe)
        self.known = Pieces(CACHE_BYTES, self.kind)

    def encode(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def of_model(self, piece: str) -> list[int]:
        """The ids of one lower-case piece by the merges alone, past the steps that would leave it as it is."""
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.table))]

    def pieces(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that pieces are read from, their starts and ends, and for each whether it is an odd word, kept whole."""
        raw = w.raw
        low = LOWER[raw]
        kind = KIND[low]
        lead = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7))
        kind[lead] = kind[lead + 1] = LETTER
        capital = lead[raw[lead + 1] < 0x9F] + 1
        low[capital] += 0x20
        total = np.concatenate([[0], np.cumsum(kind == ODD, dtype=np.int32)])
        odd = total[w.ends] > total[w.starts]
        for s in self.special:  # any word with the first bytes of a special token
            at = np.flatnonzero((raw[: 1 - len(s[:2]) or None] == s[0]) & (raw[len(s[:2]) - 1 :] == s[:2][-1]))
            odd[np.searchsorted(w.starts, at, "right") - 1] |= len(at) > 0
        size = w.ends[odd] - w.starts[odd]
        inside = np.arange(int(size.sum())) + np.repeat(w.starts[odd] - (np.cumsum(size) - size), size)
        kind[inside] = ODD
        low[inside] = raw[inside]
        change = np.ones(len(kind) + 1, bool)
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        at = np.flatnonzero(change)
        word = kind[at[:-1]] != BLANK if len(at) else np.empty(0, bool)
        starts, ends = at[:-1][word], at[1:][word]
        return low, starts, ends, kind[starts] == ODD

    def ids(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with its end, and the places where the texts begin, the end of the last one included.

        A piece is looked up once however often the texts have it; pieces are the same if their hashes and bytes are."""
        w = Words(texts)
        raw, starts, ends, odd = self.pieces(w)
        key, first, of = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        size = ends - starts
        alike = (size == size[first[of]]).all() and np.array_equal(gathered(raw, starts, size), gathered(raw, starts[first[of]], size))
        if not alike:  # two pieces of one hash: none of them is looked up or remembered
            key, first, of = None, np.arange(len(starts)), np.arange(len(starts))
        at = self.known.find(key, raw, starts[first], size[first]) if alike else np.full(len(first), -1)
        miss = np.flatnonzero(at < 0)
        new = []
        for i in first[miss].tolist():
            piece = raw[starts[i] : ends[i]].tobytes().decode()
            new.append(self.encode(piece) if odd[i] or not self.direct else self.of_model(piece))
        n = np.empty(len(first), np.int64)
        n[miss] = np.fromiter(map(len, new), np.int64, len(new))
        n[at >= 0] = self.known.ids_size[at[at >= 0]]
        base = np.empty(len(first), np.int64)  # of the ids of a piece: first those found, then the new ones
        flat = np.array([x for ids in new for x in ids], "<u4")
        base[at >= 0] = self.known.ids_at[at[at >= 0]]
        base[miss] = len(self.known.ids) + np.cumsum(n[miss]) - n[miss]
        every = np.concatenate([self.known.ids.astype("<u4"), flat]) if len(miss) else self.known.ids
        own = gathered(every, base[of], n[of])
        if alike and len(miss):
            self.known.add(key[miss], raw, starts[first[miss]], size[first[miss]], flat, n[miss])
        doc = np.searchsorted(w.offset, starts, "right") - 1
        out = np.full(len(own) + len(texts), END, "<u4")
        out[np.arange(len(own)) + np.repeat(doc, n[of])] = own
        return out, np.concatenate([[0], np.cumsum(np.bincount(doc, n[of], len(texts)).astype(np.int64) + 1)])

    def long_ids(self, text: bytes, limit: int) -> np.ndarray:
        """The ids of one text of any length, which is read in parts of about ``limit`` bytes that end at white space."""
        out, a = [], 0
        while a < len(text):
            cut = SPACES.search(text, a + limit)
            b = cut.start() if cut else len(text)
            out.append(self.ids([text[a:b]])[0][:-1])
            a = b
        return np.concatenate([*out, np.array([END], "<u4")])


def tokenizer(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def _pieces(path: str, length: int):
    def run(batches):
        t = tokenizer(path)
        for batch in small_batches(batches, SLICE):
            texts = binary(batch.column("text"))
            if len(texts) == 1 and len(texts[0] or b"") > SLICE:
                ids = t.long_ids(texts[0], SLICE)
                edge = np.array([0, len(ids)])
            else:
                ids, edge = t.ids(texts)
            size = np.diff(edge)
            many = -(-size // length)
            doc = np.repeat(np.arange(len(texts)), many)
            start = length * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
            own = np.minimum(length, size[doc] - start)
            a = edge[doc] + start
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + own).tolist(), strict=True)]
            data = memoryview(ids.astype(t.kind).tobytes())
            unit = np.dtype(t.kind).itemsize
            rest = [None if n == length else bytes(data[unit * x : unit * (x + n)]) for x, n in zip(a.tolist(), own.tolist(), strict=True)]
            cols = [batch.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, own, crc, size[doc])), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """The x >= 0 with the least |a x - b|, by active sets."""
    x, live = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    w = a.T @ (b - a @ x)
    limit = 1e-9 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds):
        if live.all() or w[~live].max(initial=-1.0) <= limit or live.sum() >= a.shape[0]:
            break
        live[np.argmax(np.where(live, -np.inf, w))] = True
        while True:
            s = np.zeros_like(x)
            s[live] = np.linalg.lstsq(a[:, live], b, rcond=None)[0]
            low = live & (s <= 0)
            if not low.any():
                x = s
                break
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            live &= x > 1e-12
            x[~live] = 0
        w = a.T @ (b - a @ x)
    return x


def combinations(have: np.ndarray, full: int) -> list[tuple[int, ...]]:
    """Classes (with some remainder in them) that add up to a window: all pairs and triples, fours of a coarse grid."""
    on = have > 0
    out = [(i, full - i) for i in range(1, full // 2 + 1) if on[i] and on[full - i]]
    out += [(i, j, full - i - j) for i in range(1, full // 3 + 1) if on[i] for j in range(i, (full - i) // 2 + 1) if on[j] and on[full - i - j]]
    grid = [i for i in range(full // 32, full, full // 32) if on[i]]
    out += [(i, j, k, r) for i in grid for j in grid if j >= i for k in grid if k >= j and (r := full - i - j - k) >= k and on[r]]
    if on[full]:
        out.append((full,))
    return out


def plan(have: np.ndarray, full: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with their repeat counts, which together take no more of any class than there is."""
    combos = combinations(have, full)
    if not combos:
        return []
    use = np.array([np.bincount(c, minlength=full + 1) for c in combos], np.int32)
    scale = float(have.max())
    rows = np.flatnonzero(have > 0)
    if len(combos) > 8 * len(rows):  # a shallow first choice: least squares needs no more columns than there are rows
        value = (have[None, :] * (use > 0)).astype(float)
        value[use == 0] = np.inf
        chosen = np.argsort(-value.min(axis=1), kind="stable")[: 8 * len(rows)]
        combos, use = [combos[i] for i in chosen], use[chosen]
    x = nnls(use.T[rows].astype(float), have[rows] / scale) * scale
    left, times = have.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    order = np.argsort(-x, kind="stable")
    for rounding in (lambda i: int(x[i]), lambda i: 1 << 62):  # as solved, then what rounding has left over
        for i in order:
            own = np.flatnonzero(use[i])
            n = min(rounding(i), int((left[own] // use[i][own]).min()))
            if n > 0:
                times[i] += n
                left[own] -= n * use[i][own]
    return [(combos[i], int(times[i])) for i in order if times[i]]


def _cut(path: str, length: int):
    """Leftover remainders with their ids and their place in a lane, to pieces cut at the ends of sequences."""

    def run(batches):
        kind = tokenizer(path).kind
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], kind).astype("<u4").tobytes()
                at, end, lane = r["before"], r["before"] + r["length"], r["lane_ids"]
                base = start = r["start"]
                while at < end:
                    full = lane // length * length
                    if at < full:
                        first = at // length * length
                        stop = first + length
                    else:  # the tail: the binary digits of its length, largest first
                        first, rest = full, lane - full
                        while True:
                            size = 1 << (rest.bit_length() - 1)
                            if at < first + size:
                                break
                            first, rest = first + size, rest - size
                        stop = first + size
                    n = min(end, stop) - at
                    out.append((r["doc_id"], start, n, zlib.crc32(ids[4 * (start - base) : 4 * (start - base + n)]), r["doc_tokens"], r["lane"], first, at - first))
                    start, at = start + n, at + n
            cols = list(zip(*out, strict=True)) or [[] for _ in range(8)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lane", "first", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names)

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    bound_arrow(docs.sparkSession)
    full = length // step
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    made = stage(texts.mapInArrow(_pieces(path, length), kind).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = made.where(F.col("length") == length).select(*columns[:5], (F.col("piece") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = made.where(F.col("length") < length).drop("ids").withColumn("class", F.ceil(F.col("length") / step).cast("int"))
    have = np.zeros(full + 1, np.int64)
    for r in short.groupBy("class").agg(F.count("*").alias("n")).collect():
        have[r["class"]] = r["n"]
    slots: list[tuple[int, int, int, int, int, int]] = []  # class, first rank, after the last, sequences before, slots of it in a sequence, slots before
    at, seq = np.zeros(full + 1, np.int64), 0
    for combo, n in plan(have, full):
        for k, c in enumerate(sorted(set(combo))):
            m = combo.count(c)
            slots.append((c, int(at[c]), int(at[c] + n * m), seq, m, sum(x < c for x in combo)))
            at[c] += n * m
        seq += n
    spark = docs.sparkSession
    shards = min(MAX_SHARDS, max(1, int(have.max()) // SHARD))
    short = short.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards)).cast("int"))
    counts = short.groupBy("class", "shard").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(Window.partitionBy("class").orderBy("shard")) - F.col("n")).alias("before")
    base = counts.select("class", "shard", before)
    ranked = short.withColumn("own", F.row_number().over(Window.partitionBy("class", "shard").orderBy("piece")) - 1)
    ranked = ranked.join(base, ["class", "shard"]).withColumn("rank", F.col("own") + F.col("before"))
    table = spark.createDataFrame(slots, "c int, low long, high long, seq long, per long, slot long")
    dealt = stage(ranked.join(F.broadcast(table), (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left"), "dealt")
    rank = F.col("rank") - F.col("low")
    in_combo = dealt.where("c is not null").select(
        *columns[:5], ((F.col("seq") + F.floor(rank / F.col("per"))) * 4 + 1).cast("long").alias("sequence_id"), (F.col("slot") + rank % F.col("per")).alias("slot")
    )
    place = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    in_combo = in_combo.select(*columns[:6], F.coalesce(place, F.lit(0)).cast("long").alias("offset"))
    left = dealt.where("c is null").select(*columns[:5], "piece")
    lanes = max(1, int(left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]) // LANE)
    left = left.withColumn("lane", F.pmod(F.xxhash64("piece", F.lit(5)), F.lit(lanes)))
    by = Window.partitionBy("lane")
    run = F.sum("length").over(by.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    left = left.select("*", F.coalesce(run, F.lit(0)).alias("before"), F.sum("length").over(by).alias("lane_ids"))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, lane long, first long, offset long"
    ids = made.where(F.col("length") < length).select("piece", "ids")
    cut = left.join(ids, "piece").select("ids", "doc_id", "start", "length", "doc_tokens", "lane", "before", "lane_ids").mapInArrow(_cut(path, length), kind)
    in_lane = cut.select(*columns[:5], ((F.col("lane") * (4 * LANE) + F.col("first")) * 4 + 2).alias("sequence_id"), "offset")
    return whole.unionByName(in_combo).unionByName(in_lane)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing_nnls(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
