"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius by BK-trees.

Fingerprints that differ in at most ``radius`` bits agree in one of ``radius + 1`` blocks of bits, so each distinct
fingerprint is dealt to one shard per block. A shard holds a BK-tree (children keyed by their Hamming distance to the
parent) that is searched along the edges within the radius. Trees of all fingerprints have no bound on their size, so
shards are co-located by key rather than broadcast. A shard above ``hot`` fingerprints is dealt again by blocks of the
remaining bits. A shard reports a star for each group it finds, so output grows with fingerprints and not with pairs.

Defined results: a text of any length is read whole; a bit set in just half of the hashes is 0; null and empty texts have fingerprint zero, linked like any other; equal fingerprints are linked;
repeated ids keep their rows and share a component; a null doc_id stays null and is nobody's representative unless all
ids of the group are null; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.components import components, stars
from spanlens.llm.shared import bound_arrow, stage
from spanlens.llm.words import Words, binary, small_batches

SHINGLE = 3
RADIUS = 3
SEED = 42
SCALAR = 24


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """The fingerprint of one word list; zero if there is no word."""
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(length)
    starts = ends - length
    ends = ends[size - 1 :] - 1
    total, n = np.zeros(64, np.int64), len(ends)
    for a in range(0, n, 1 << 16):
        pairs = zip(starts[a : a + (1 << 16)].tolist(), ends[a : a + (1 << 16)].tolist(), strict=False)
        h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in pairs), np.dtype("<u8"))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in small_batches(batches):
        texts = binary(batch.column("text"))
        w = np.array([fingerprint((t or b"").lower().split()) for t in texts], np.uint64)
        own = [c for c in batch.schema.names if c not in ("doc_id", "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.view(np.int64)), *map(batch.column, own)], ["doc_id", "fp", *own])


def blocks(width: int, n: int) -> list[tuple[int, int]]:
    """Shifts and widths of n blocks that make up ``width`` bits."""
    edges = [width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


class BKTree:
    """A BK-tree over integers; children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.value: list[int] = []
        self.child: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        if self.value:
            at = 0
            while (d := (x ^ self.value[at]).bit_count()) and d in self.child[at]:
                at = self.child[at][d]
            if d == 0:
                return
            self.child[at][d] = len(self.value)
        self.value.append(x)
        self.child.append({})

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (x ^ self.value[at]).bit_count()
            if d <= radius:
                found.append(self.value[at])
            child = self.child[at]
            if len(child) <= 2 * radius:
                todo += [c for k, c in child.items() if d - radius <= k <= d + radius]
            else:
                todo += [child[k] for k in range(d - radius, d + radius + 1) if k in child]
        return found

    def within_all(self, queries: np.ndarray, radius: int, near) -> None:
        """Searches for many values at once; ``near(value, values)`` gets what lies within the radius of each node.

        Values are sifted for a child when its turn comes, so that what is held follows the depth of the tree."""
        todo = [(0, 0, np.arange(len(queries), dtype=np.int32), np.zeros(len(queries), np.int8))] if self.value else []
        while todo:
            at, edge, live, far = todo.pop()
            live = live[np.abs(far - edge) <= radius]
            if not live.size:
                continue
            d = np.bitwise_count(queries[live] ^ np.uint64(self.value[at])).astype(np.int8)
            if (hit := live[d <= radius]).size:
                near(self.value[at], queries[hit])
            todo += [(c, k, live, d) for k, c in self.child[at].items()]


def links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect all values within the radius of each other; values are distinct."""
    tree, a, b = BKTree(), [], []
    if len(values) <= SCALAR:
        for x in values.tolist():
            for y in tree.within(x, radius):
                a.append(x)
                b.append(y)
            tree.add(x)
        pairs = np.array(a, np.uint64), np.array(b, np.uint64)
    else:
        for x in values.tolist():
            tree.add(x)
        held, kept = 0, []

        def near(value: int, others: np.ndarray) -> None:
            nonlocal held, kept
            others = others[others > np.uint64(value)]
            kept.append((np.full(len(others), value, np.uint64), others))
            held += len(others)
            if held > 200_000:  # what is found is kept as stars, so that memory follows the values
                kept = [stars(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))]
                held = len(kept[0][0])

        tree.within_all(values, radius, near)
        pairs = (np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])) if kept else (values[:0], values[:0])
    return stars(*pairs)


def _shards(radius: int):
    """Rows (shard, fp), sorted by shard, to the stars of each shard; one shard is held at a time, besides a batch."""

    def stars_of(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        size = np.diff(edge)
        out = [links(np.sort(fp[edge[i] : edge[i + 1]]), radius) for i in np.flatnonzero(size > 1)]
        if not out:
            return None
        a, b = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        shard, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            shard = np.concatenate([shard, batch.column("shard").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0  # the last shard may go on in the next batch
            if cut and (out := stars_of(shard[:cut], fp[:cut])) is not None:
                yield out
            shard, fp = shard[cut:], fp[cut:]
        if len(shard) and (out := stars_of(shard, fp)) is not None:
            yield out

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, hot: int = 20_000) -> DataFrame:
    """Stars (a, b) over the distinct fingerprints ``fp`` that link all those within ``radius`` bits."""
    n = radius + 1
    key = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1).alias("v")) for i, (s, w) in enumerate(blocks(64, n))]
    dealt = fps.select("fp", F.explode(F.array(*key)).alias("k")).select("fp", "k.i", "k.v")
    large = stage(dealt.groupBy("i", "v").agg(F.count("*").alias("n")).where(F.col("n") > hot), "hot-shards")
    plain = F.xxhash64("i", "v").alias("shard")
    if large.isEmpty():
        parts = dealt.select(plain, "fp")
    else:  # the other bits of a large shard, in blocks of their own: one of them agrees too
        again = []
        for i, (s, w) in enumerate(blocks(64, n)):
            low = F.col("fp").bitwiseAND((1 << s) - 1)
            rest = low.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", s + w), s)) if s + w < 64 else low
            rows = dealt.where(F.col("i") == i).join(large.drop("n"), ["i", "v"], "left_semi")
            for j, (s2, w2) in enumerate(blocks(64 - w, n)):
                again.append(rows.select(F.xxhash64("i", "v", F.lit(j), F.shiftrightunsigned(rest, s2).bitwiseAND((1 << w2) - 1)).alias("shard"), "fp"))
        parts = dealt.join(large.drop("n"), ["i", "v"], "left_anti").select(plain, "fp")
        for x in again:
            parts = parts.unionByName(x)
    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards(radius), "a long, b long")


def _grouped(docs: DataFrame, radius: int, hot: int, same: bool = False) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``, and with ``same`` a hash of its text; root is the group's own key."""
    bound_arrow(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.xxhash64("text").alias("same")] * same)
    prints = stage(rows.mapInArrow(_fingerprints, "doc_id long, fp long" + ", same long" * same), "fingerprints")
    reps = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    edges = stage(fingerprint_links(reps.select("fp"), radius, hot), "links")  # else a task would hold two Python workers
    root = components(edges).withColumnRenamed("node", "fp")
    rooted = reps.join(root, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, hot: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    return _grouped(docs, radius, hot).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprint as 16 hexadecimal digits and the smallest doc_id of its group."""
    out = simhash_groups(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op9_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def deduplicate(docs: DataFrame, radius: int = RADIUS, hot: int = 20_000) -> DataFrame:
    """One row of each group stays: one with the smallest doc_id. Rows with a null id stay only if their group has no other id.

    Ids can be null or repeated in several groups, so a row is known by its id and text; of rows with the smallest id, the
    smallest by fingerprint and hash of the text stays, and one of those equal in both. Rows are carried in a struct, so that
    columns may have any name."""
    rows = _grouped(docs, radius, hot, same=True).where("doc_id <=> component_id")
    rows = rows.groupBy("root", "doc_id", "fp", "same").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct("fp", "same", "doc_id", "n")).alias("x"))
    keep = stage(first.select(F.col("x.doc_id").alias("id"), F.col("x.same").alias("same"), F.col("x.n").alias("n")), "kept-rows")
    all_ = docs.select(F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("own_same"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = all_.join(keep.drop("n"), F.col("own").eqNullSafe(F.col("id")) & (F.col("own_same") == F.col("same")), "left_semi")
    if not keep.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["own", "own_same"])
    return kept.select(*(F.col(f"row.`{c}`") for c in docs.columns))
