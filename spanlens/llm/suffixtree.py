"""Scoring by a probabilistic suffix tree over words: contexts of varying length, kept where they change what comes next.

A pass over the training texts counts tokens, and a further pass for each length of context, up to ``DEPTH``, what follows
the contexts of that length. Whatever occurs ``LEAST`` times is counted, in a corpus of any size. A context is kept if its
next-symbol distribution diverges from that of its suffix: count times Kullback-Leibler divergence, in nats, at least
``DIVERGENCE``. Growth ends where no context is left. A state's distribution is smoothed with that of its suffix by the number
of symbols that follow it (Witten and Bell) and what has no entry, down to the base distribution of single tokens; it adds up
to one over the vocabulary and one unknown symbol. A position is scored by the longest kept suffix of the words before it.

Counts and tree are written tables. A kept context multiplies what follows it by a factor, and an entry by a further one, so
a text's score is a sum over its runs of words (grams) of what the tables have for each, and a join on the gram finds it. Two
things of fixed size are broadcast, and save work without any effect on results: the ``HOT`` most frequent grams, looked up
where the texts are read, and a Bloom filter of the others, which drops most grams that no table has.

Counts cover all training texts; they are summed per slice of the input and sent as packed rows of sorted keys to buckets of
keys, each of a bounded number of occurrences. Symbols and grams are told apart by 64-bit hashes. ``train`` and ``Tree`` are the same model held by the driver, for small tables.

Defined results: null and empty texts are the end token alone; without training documents the base has N = V = 0, every
token is unknown and its probability is one; a text of any length is read whole; of equally long known suffixes there is one
only, so that ties can't arise; rows of a repeated doc_id each get their row; a null doc_id stays null and trains as its hash says; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.shared import bound_arrow, bucket_of, drop_staged, lean_shuffles, stage, text_bytes
from spanlens.llm.words import Words, binary, lookup, mix, pack, small_batches, unpack

U = np.uint64
LEAST = 3
DIVERGENCE = 3.0
DEPTH = 3
FLUSH = 4_000_000
BUCKET = 1 << 19
MAX_BITS = 25
HOT = 1_000_000
FILTER_BITS = 28
#: The end of a text; no word's hash is set aside for it, but one of 2**64 values is.
END = U(0)


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each with its end token, and the texts they are in."""
    w = Words(texts, lower=True)
    h = np.empty(len(w.starts) + len(texts), U)
    doc = np.repeat(np.arange(len(texts)), w.n + 1)
    ends = np.cumsum(w.n + 1) - 1
    word = np.ones(len(h), bool)
    word[ends] = False
    h[word] = w.hashes()
    h[ends] = END
    return h, doc


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([k for k, _ in parts])
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)


def _count(keys_of):
    """Sums of keys over slices of bounded size, as rows (key, n)."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in small_batches(batches):
            key, n = np.unique(keys_of(binary(batch.column("text"))), return_counts=True)
            held.append((key, n))
            rows += len(key)
            if rows > FLUSH:
                held = [_summed(held)]
                rows = len(held[0][0])
                if rows > FLUSH // 2:
                    yield _rows(*held[0])
                    held, rows = [], 0
        if held:
            yield _rows(*_summed(held))

    return run


def _rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def counts(texts: DataFrame, keys_of) -> DataFrame:
    return texts.select("text").mapInArrow(_count(keys_of), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Symbols:
    """The symbols of the tree: sorted hashes and their counts."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray):
        self.hash, self.n = hashes, n

    def of(self, h: np.ndarray) -> np.ndarray:
        """Positions of hashes; -1 for what is not among them."""
        if not len(self.hash):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)


def before(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """The symbol k positions earlier in the same text; -1 if there is none."""
    out = np.full(len(ids), -1, np.int64)
    if len(ids) > k:
        out[k:] = np.where(doc[k:] == doc[:-k], ids[:-k], -1)
    return out


def _diverge(ctx: np.ndarray, n: np.ndarray, seen: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By context: what its entries count, how many there are, and its count times the divergence from its suffix.

    All symbols without an entry are one outcome of the divergence."""
    m = len(seen)
    total = np.minimum(np.bincount(ctx, n, m), seen)
    kinds = np.bincount(ctx, minlength=m).astype(np.float64)
    gain = np.bincount(ctx, n * np.log(n / np.maximum(seen[ctx], 1) / shorter), m).astype(np.float64)
    rest, other = seen - total, np.maximum(1 - np.bincount(ctx, shorter, m), 1e-12)
    gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / np.maximum(seen, 1) / other), 0)
    return total, kinds, np.where(kinds > 0, gain, 0)


def states(sym: np.ndarray, doc: np.ndarray, contexts: list[np.ndarray]) -> list[np.ndarray]:
    """For each position, the numbers of the contexts of length 1, 2, ... that end before it; -1 where there is none.

    A context of length 1 has its symbol's number. One of length k is known by the number of its first k - 1 symbols and its
    last symbol, ``number << 32 | symbol``, and is numbered by its place in the sorted ``contexts[k - 2]``."""
    out = [before(sym, doc, 1)]
    for known in contexts:
        first = before(out[-1], doc, 1)
        out.append(np.where((first >= 0) & (out[0] >= 0), lookup(known, (first << 32) | out[0]), -1))
    return out


class Level:
    """The kept contexts of one length: ``entry`` = number << 32 | symbol, counted in ``n``; by number, ``total`` is what the
    entries count (0 for a context that isn't kept) and ``weight`` that of the suffix: the number of entries and the
    occurrences that have no entry."""

    def __init__(self, entry: np.ndarray, n: np.ndarray, total: np.ndarray, weight: np.ndarray):
        self.entry, self.n, self.total, self.weight = entry, n, total, weight

    def smooth(self, number: np.ndarray, sym: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities after the contexts with these numbers; ``shorter`` where there is no such context."""
        if not len(self.entry):
            return shorter
        total = np.where(number >= 0, self.total[number], 0)
        at = lookup(self.entry, (number << 32) | sym)
        n = np.where((at >= 0) & (number >= 0) & (sym >= 0), self.n[at], 0)
        weight = np.where(total > 0, self.weight[number], 1)
        return np.where(total > 0, (n + weight * shorter) / (total + weight), shorter)


class Tree:
    """Levels of kept contexts by length, and what numbers the contexts of length 2 and more."""

    def __init__(self, symbols: Symbols, tokens: int, distinct: int):
        self.symbols, self.tokens, self.distinct = symbols, tokens, distinct
        self.levels: list[Level] = []
        self.contexts: list[np.ndarray] = []
        self.suffixes: list[list[np.ndarray]] = [[]]  # by length: for each context, the numbers of its suffixes of length 1, 2, ...

    def base(self, n: np.ndarray) -> np.ndarray:
        return (n + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def probability(self, numbers: list[np.ndarray], sym: np.ndarray, base: np.ndarray) -> np.ndarray:
        for level, number in zip(self.levels, numbers, strict=False):
            base = level.smooth(number, sym, base)
        return base

    def grow(self, seen: np.ndarray, key: np.ndarray, n: np.ndarray) -> None:
        """Adds the next length. ``seen``: counts of its contexts; ``key``: number of the context << 32 | symbol, sorted."""
        number, sym = key >> 32, key & 0xFFFFFFFF
        shorter = self.probability([s[number] for s in self.suffixes[-1]], sym, self.base(self.symbols.n[sym]))
        total, kinds, gain = _diverge(number, n, seen.astype(np.float64), shorter)
        keep = gain >= DIVERGENCE
        on = keep[number]
        self.levels.append(Level(key[on], n[on].astype(np.float64), np.where(keep, total, 0), np.where(keep, seen - total + kinds, 0)))

    def number(self, contexts: np.ndarray) -> None:
        """Numbers the contexts of the next length by their sorted keys."""
        first, last = contexts >> 32, contexts & 0xFFFFFFFF
        own = [last]
        for known, suffix in zip(self.contexts, self.suffixes[-1], strict=False):
            own.append(np.where(suffix[first] >= 0, lookup(known, (suffix[first] << 32) | last), -1))
        self.contexts.append(contexts)
        self.suffixes.append(own)

    def log10(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token, log10 of its probability over its base probability, and whether its count is known here.

        A token without entries has probability proportional to its base, so the ratio holds whatever its count."""
        sym = self.symbols.of(h)
        known = sym >= 0
        base = np.where(known, self.base(self.symbols.n[sym] if len(self.symbols.n) else np.zeros(len(sym))), 1.0)
        return np.log10(self.probability(states(sym, doc, self.contexts), sym, base) / base), known

    def slim(self) -> Tree:
        """What scoring needs."""
        out = Tree(self.symbols, self.tokens, self.distinct)
        out.levels, out.contexts = self.levels, self.contexts[: len(self.levels) - 1]
        return out


def _entries(shared):
    def keys(texts: list[bytes | None]) -> np.ndarray:
        symbols, contexts = shared.value
        h, doc = _tokens(texts)
        sym = symbols.of(h)
        number = states(sym, doc, contexts)[-1]
        on = (sym >= 0) & (number >= 0)
        return ((number[on] << 32) | sym[on]).view(U)

    return keys


def _arrays(df: DataFrame, columns: int = 2) -> list[np.ndarray]:
    """The columns of a table of bounded size, sorted by the first."""
    table = df.toArrow()
    out = [np.asarray(table.column(i).combine_chunks(), np.int64) for i in range(columns)]
    order = np.argsort(out[0].view(U) if columns == 2 else out[0], kind="stable")
    return [x[order] for x in out]


def _columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size, sorted by the first as unsigned numbers."""
    table = df.toArrow()
    out = [np.asarray(c.combine_chunks()) for c in table.columns]
    order = np.argsort(out[0].view(U), kind="stable")
    return [x[order] for x in out]


def train(texts: DataFrame, depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """The tree in the driver's memory, and the table (key, n) of all token counts."""
    spark = texts.sparkSession
    bound_arrow(spark)
    single = stage(counts(texts, lambda t: _tokens(t)[0]), "token-counts")
    total, distinct = single.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    key, n = _arrays(single.where(F.col("n") >= LEAST))
    symbols = Symbols(key.view(U), n)
    tree = Tree(symbols, total, distinct)
    seen = symbols.n
    for length in range(1, depth + 1):
        shared = spark.sparkContext.broadcast((symbols, tree.contexts))
        key, n = _arrays(stage(counts(texts, _entries(shared)).where(F.col("n") >= LEAST), f"following-{length}"))
        tree.grow(seen, key, n)
        if not len(key) or length == depth:
            break
        tree.number(key)
        seen = n
    return tree.slim(), single


def _lean(df: DataFrame, name: str) -> DataFrame:
    with lean_shuffles(df.sparkSession):
        return stage(df, name)


def pair(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The key of a gram from those of the grams without its last and without its first word."""
    return mix(context * U(0x9E3779B97F4A7C15) + suffix)


class Filter:
    """A Bloom filter over keys, of at most ``FILTER_BITS`` address bits; the fuller it is, the less it drops."""

    def __init__(self, keys: DataFrame):
        bits = min(FILTER_BITS, max(16, (16 * keys.count()).bit_length()))
        self.shift = 64 - bits
        words = keys.select(F.shiftrightunsigned("key", self.shift + 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {self.shift}) & 63 as int))").alias("bit"))
        words = _lean(words.groupBy("word").agg(F.bit_or("bit").alias("bits")), "filter")
        at, held = _arrays(words)
        drop_staged(words)
        self.words = np.zeros(1 << (bits - 6), U)
        self.words[at] = held.view(U)

    def has(self, key: np.ndarray) -> np.ndarray:
        place = key >> U(self.shift)
        return (self.words[place >> U(6)] >> (place & U(63))) & U(1) == 1


def grams(h: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of ``length`` tokens that end at each position, and where such a run lies in one text."""
    key, on = h, np.ones(len(h), bool)
    for k in range(1, length):
        key = np.concatenate([key[:1], pair(key[:-1], key[1:])])
        on = np.concatenate([np.zeros(min(k, len(h)), bool), doc[k:] == doc[:-k]])
    return key, on


def context_of(key: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The context of a gram's key: ``pair`` undone."""
    h = key ^ (key >> U(29)) ^ (key >> U(58))
    h = h * U(pow(0xD6E8FEB86659FD93, -1, 2**64))
    h ^= h >> U(32)
    return (h - suffix) * U(pow(0x9E3779B97F4A7C15, -1, 2**64))


MESSAGE = "bucket int, n int, keys binary, suffixes binary, times binary"


def _messages(bits: int, key: np.ndarray, suffix: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    """Sorted keys with their counts as one packed row for each bucket of keys, named by their first bits."""
    bucket = (key >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)
    edge = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist(), len(key)] if len(key) else [0]
    parts = list(zip(edge, edge[1:], strict=False))
    times = [n[a:b].astype(np.min_scalar_type(int(n[a:b].max()))) for a, b in parts]
    cols = [
        pa.array(bucket[edge[:-1]]), pa.array([b - a for a, b in parts], pa.int32()), pa.array([pack(key[a:b]) for a, b in parts], pa.binary()),
        pa.array([b"" if suffix is None else suffix[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([t.tobytes() for t in times], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "n", "keys", "suffixes", "times"])


def _reduced(least: int, grams_: bool):
    """The messages of one bucket to rows of the keys that occur ``least`` times: (key, n), of grams (key, context, suffix, n)."""

    def run(table):
        rows = table.to_pylist()
        key = np.concatenate([unpack(r["n"], r["keys"]) for r in rows])
        n = np.concatenate([np.frombuffer(r["times"], f"<u{len(r['times']) // r['n']}").astype(np.int64) for r in rows])
        key, first, at = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(at, n, len(key)).astype(np.int64)
        on = n >= least
        out = {"key": pa.array(key[on].view(np.int64))}
        if grams_:
            suffix = np.concatenate([np.frombuffer(r["suffixes"], "<u8") for r in rows])[first[on]]
            out |= {"context": pa.array(context_of(key[on], suffix).view(np.int64)), "suffix": pa.array(suffix.view(np.int64))}
        return pa.table(out | {"n": pa.array(n[on])})

    return run


def packed_counts(texts: DataFrame, found, bits: int, least: int, grams_: bool) -> DataFrame:
    """Counts over all texts. ``found`` gives the keys, and of grams the suffixes, of the occurrences in a slice of texts.

    Slices are summed up to ``FLUSH`` keys at a time; a bucket has about ``BUCKET`` occurrences, whatever the corpus' size."""

    def run(batches):
        held: list[tuple] = []
        rows = 0

        def summed(parts):
            key = np.concatenate([p[0] for p in parts])
            key, first, at = np.unique(key, return_index=True, return_inverse=True)
            n = np.bincount(at, np.concatenate([p[2] for p in parts]), len(key)).astype(np.int64)
            return key, np.concatenate([p[1] for p in parts])[first] if grams_ else None, n

        for batch in small_batches(batches):
            key, suffix = found(binary(batch.column("text")))
            held.append(summed([(key, suffix, np.ones(len(key), np.int64))]))
            rows += len(held[-1][0])
            if rows > FLUSH:
                held = [summed(held)]
                rows = len(held[0][0])
                if rows > FLUSH // 2:
                    yield _messages(bits, *held[0])
                    held, rows = [], 0
        if held:
            yield _messages(bits, *summed(held))

    kind = "key long, context long, suffix long, n long" if grams_ else "key long, n long"
    return texts.select("text").mapInArrow(run, MESSAGE).groupBy("bucket").applyInArrow(_reduced(least, grams_), kind)


def _following(shared, length: int):
    """The grams one longer than ``length`` in a slice of texts, whose parts may both be known."""

    def found(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        h, doc = _tokens(texts)
        key, on = grams(h, doc, length)
        if length > 1:
            on &= shared.value.has(key)
        both = np.flatnonzero(on[:-1] & on[1:] & (doc[:-1] == doc[1:]))
        return pair(key[both], key[both + 1]), key[both + 1]

    return found


def grow(counted: DataFrame, shorter: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """From the counts after contexts of one length and the grams (key, n, p) of that length: the grams one longer, with the
    gain of those that are entries of a kept context, and the kept contexts (key, n, gain)."""
    suffix = shorter.select(F.col("key").alias("suffix"), F.col("p").alias("shorter"))
    entries = _lean(counted.join(suffix, "suffix").select("key", "context", "n", "shorter"), f"entries-{length}")
    drop_staged(counted)
    sums = entries.groupBy("context").agg(
        F.sum("n").alias("sum"), F.count("*").alias("kinds"), F.sum("shorter").alias("covered"), F.sum(F.col("n") * F.log(F.col("n") / F.col("shorter"))).alias("own")
    )
    both = sums.join(shorter.select(F.col("key").alias("context"), F.col("n").alias("seen")), "context").withColumn("total", F.least("sum", "seen"))
    rest, other = F.col("seen") - F.col("total"), F.greatest(1 - F.col("covered"), F.lit(1e-12))
    divergence = F.col("own") - F.col("sum") * F.log("seen") + F.when(rest > 0, rest * F.log(rest / F.col("seen") / other)).otherwise(0.0)
    kept = both.where(divergence >= DIVERGENCE).select("context", "seen", "total", (rest + F.col("kinds")).alias("weight"))
    kept = _lean(kept, f"contexts-{length}")
    away = F.col("weight") * F.col("shorter")
    joined = entries.join(kept, "context", "left").select(
        "key", "n", F.when(F.col("total").isNull(), F.col("shorter")).otherwise((F.col("n") + away) / (F.col("total") + F.col("weight"))).alias("p"),
        F.log10(1 + F.col("n") / away).alias("gain"),
    )
    back = kept.select(F.col("context").alias("key"), F.col("seen").alias("n"), F.log10(F.col("weight") / (F.col("total") + F.col("weight"))).alias("gain"))
    out = _lean(joined, f"grams-{length + 1}")
    drop_staged(entries)
    return out, back


def tables(texts: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, int, int]:
    """The model: rows (key, n, base, known, gain) of grams, the training tokens, and how many are distinct.

    ``base`` is log10 of a token's base probability over that of an unknown one, ``gain`` what the gram adds to a score."""
    spark = texts.sparkSession
    bound_arrow(spark)
    bits = max(0, min(MAX_BITS, math.ceil(math.log2(max(1, text_bytes(texts) / 6 / BUCKET)))))
    single = _lean(packed_counts(texts, lambda t: (_tokens(t)[0], None), bits, 1, False), "token-counts")
    total, distinct = single.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    grown = single.where(F.col("n") >= LEAST).select("key", "n", ((F.col("n") + 0.5) / F.lit(total + 0.5 * (distinct + 1))).alias("p"))
    parts = [single.select("key", "n", F.log10((F.col("n") + 0.5) / 0.5).alias("base"), F.lit(1).alias("known"), F.lit(0.0).alias("gain"))]
    used = [single]
    for length in range(1, depth + 1):
        shared = spark.sparkContext.broadcast(Filter(grown.select("key")) if length > 1 else None)
        counted = _lean(packed_counts(texts, _following(shared, length), bits, LEAST, True), f"following-{length}")
        shared.destroy()
        if counted.isEmpty():
            break
        grown, back = grow(counted, grown, length)
        used += [grown, back]
        for x in (grown.where("gain is not null").select("key", "n", "gain"), back):
            parts.append(x.select("key", "n", F.lit(0.0).alias("base"), F.lit(0).alias("known"), "gain"))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    rows = rows.groupBy("key").agg(F.max("n").alias("n"), F.sum("base").alias("base"), F.sum("known").alias("known"), F.sum("gain").alias("gain"))
    model = _lean(rows, "model")
    for x in used:
        drop_staged(x)
    return model, total, distinct


def _hot(model: DataFrame) -> tuple[DataFrame, int]:
    """The most frequent grams, at most ``HOT``, and the count from which on a gram is one of them."""
    size = F.floor(F.log2("n") * 8).cast("int")
    least, taken = 1 << 62, 0
    for r in sorted(model.groupBy(size.alias("size")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect(), reverse=True):
        taken += r["rows"]
        if taken > HOT:
            break
        least = r["least"]
    return model.where(F.col("n") >= least), least


def _score(shared, depth: int):
    def run(batches):
        hot, base, known, gain, any_of = shared.value
        for batch in small_batches(batches):
            h, doc = _tokens(binary(batch.column("text")))
            n = batch.num_rows
            sums = [np.zeros(n) for _ in range(3)]
            rare, of = [], []
            for length in range(1, depth + 2):
                key, on = grams(h, doc, length)
                on &= any_of.has(key)
                key, d = key[on], doc[on]
                one, back = np.unique(key, return_inverse=True)
                at = lookup(hot, one)[back]
                for total, values in zip(sums, (base, known, gain), strict=True):
                    total += np.bincount(d[at >= 0], values[at[at >= 0]], n)
                rare.append(key[at < 0])
                of.append(d[at < 0])
            rare, of = np.concatenate(rare), np.concatenate(of)
            edge = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
            cols = [
                batch.column("doc_id"),
                pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                *(pa.array(x) for x in sums),
                pa.ListArray.from_arrays(pa.array(edge), pa.array(rare[np.argsort(of, kind="stable")].view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "hot_base", "hot_known", "hot_gain", "rare"])

    return run


def score(docs: DataFrame, train_docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``, learned from ``train_docs``."""
    model, tokens, distinct = tables(train_docs, depth)
    frequent, least = _hot(model)
    key, base, known, gain = _columns(frequent.select("key", "base", "known", "gain"))
    shared = docs.sparkSession.sparkContext.broadcast((key.view(U), base, known, gain, Filter(model.select("key"))))
    kind = "doc_id long, n_tokens long, hot_base double, hot_known double, hot_gain double, rare array<long>"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared, depth), kind)
    own = stage(own.withColumn("row", F.monotonically_increasing_id()), "scored")
    shared.destroy()
    rare = own.select("row", F.explode("rare").alias("key")).join(model.where(F.col("n") < least).drop("n"), "key")
    sums = rare.groupBy("row").agg(*(F.sum(c).alias(f"rare_{c}") for c in ("base", "known", "gain")))
    out = own.drop("rare").join(sums, "row", "left")
    unknown = F.log10(F.lit(0.5 / (tokens + 0.5 * (distinct + 1))))
    base, gain = (F.col(f"hot_{c}") + F.coalesce(f"rare_{c}", F.lit(0.0)) for c in ("base", "gain"))
    base = base + F.col("n_tokens") * unknown
    return out.select(
        "doc_id", "n_tokens", (F.col("hot_known").cast("long") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + gain).alias("score"),
    )


def op8_suffix_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, docs.where(bucket_of("doc_id", 5) != 1))
    return out.select("doc_id", (bucket_of("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
