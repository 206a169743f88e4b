"""Toxicity by multiple-instance learning: documents carry labels, sentences carry scores, noisy-or ties them together.

A sentence's score is a logistic function of its words and their beginnings (hashed, lower case, each once); a document's
score is 1 - prod(1 - sentence score). Weights are trained by gradient descent on the document labels alone, and then point
at the sentences that make a document toxic. Only features whose share of toxic documents differs from the overall share by
``DEVIATIONS`` standard deviations get a weight: what a few documents happen to share would otherwise be learned by heart.

Training takes at most ``per_class`` labelled doc_ids of each class, those with the smallest hashes. Features are
counted on the executors; the telling features of those documents, not their texts, go to the driver. Scoring reads every
whole text, of any length.

Defined results: null and empty texts have no sentence and score 0; a score equal to a threshold reaches it; of equal hashes
of doc_ids the smaller id is learned from; without labels of both classes every score is 0;
labels that are null are ignored, and where a doc_id has several labels, the largest counts; rows of a repeated doc_id
each get their score; a null doc_id has no label; an empty table gives an empty table. Only ``doc_id`` and ``text`` are
read from documents, ``doc_id`` and ``toxic`` from labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.shared import bound_arrow, bucket_of, drop_staged, hashed_sample, stage
from spanlens.llm.words import SPACE, Words, binary, hash_spans, small_batches

BITS = 20
DIMS = 1 << BITS
BEGINNINGS = (5, 6, 7, 8)
PER_CLASS = 3000
THRESHOLD = 0.7
EPOCHS = 15
LEAST_DOCS = 3
DEVIATIONS = 3.0
BREAK = SPACE.copy()
BREAK[list(range(33, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 127))] = True
STOP = np.zeros(256, np.int64)
STOP[[10, 33, 46, 63]] = 1
RESULT = "doc_id long, score double, sentences int, offending array<struct<start:int,end:int,score:double>>"


class Sentences:
    """Words of texts as hashed features, each once a sentence, and the sentences they are in."""

    def __init__(self, texts: list[bytes | None]):
        self.words = Words(texts, lower=True, space=BREAK)
        w = self.words
        mark = np.concatenate([[0], np.cumsum(STOP[w.raw])])[w.starts] if len(w.starts) else np.empty(0, np.int64)
        new = np.ones(len(mark), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (w.doc[1:] != w.doc[:-1])
        self.of_word = np.cumsum(new) - 1
        self.doc = w.doc[new].astype(np.int64)
        self.start = w.starts[new]
        self.end = w.ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(mark) - 1]])] if len(mark) else np.empty(0, np.int64)
        hashes, of_word = [w.hashes()], [self.of_word]
        for n in BEGINNINGS:  # bytes
            on = np.flatnonzero(w.ends - w.starts > n)
            hashes.append(hash_spans(w.raw, w.starts[on], w.starts[on] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
            of_word.append(self.of_word[on])
        feature = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
        pair = np.unique(np.concatenate(of_word) * DIMS + feature)
        self.sentence, self.feature = pair // DIMS, pair % DIMS


def _counted(batches):
    """In how many documents of either label each feature is, by slice of the input."""
    for batch in small_batches(batches):
        s = Sentences(binary(batch.column("text")))
        toxic = batch.column("label").to_numpy() > 0
        pair = np.unique(s.doc[s.sentence] * DIMS + s.feature) if len(s.sentence) else np.empty(0, np.int64)
        feature, yes = pair % DIMS, toxic[pair // DIMS].astype(np.float64)
        own, at = np.unique(feature, return_inverse=True)
        n, hit = np.bincount(at, minlength=len(own)), np.bincount(at, yes, len(own))
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(hit.astype(np.int64))], ["feature", "n", "toxic"])


def _packed(telling):
    """Documents as their number of sentences and the telling features in them, by their place in ``telling``."""

    def run(batches):
        known = telling.value
        for batch in small_batches(batches):
            s = Sentences(binary(batch.column("text")))
            at = np.minimum(np.searchsorted(known, s.feature), len(known) - 1)
            on = known[at] == s.feature
            sentence, feature = s.sentence[on], at[on].astype(np.int32)
            doc = s.doc[sentence] if len(sentence) else sentence
            edge, first = np.searchsorted(doc, np.arange(batch.num_rows + 1)), np.searchsorted(s.doc, np.arange(batch.num_rows + 1))
            parts = [((sentence[a:b] - f).astype(np.int32).tobytes(), feature[a:b].tobytes()) for a, b, f in zip(edge, edge[1:], first, strict=False)]
            cols = [batch.column("label"), pa.array(np.diff(first).astype(np.int32)), *(pa.array([x[i] for x in parts], pa.binary()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, ["label", "sentences", "sentence", "feature"])

    return run


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """The ``per_class`` labelled doc_ids of each label with the smallest hashes, all of them where there are fewer; and the counts of labels."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect() if r["label"] in (0, 1)}
    chosen = hashed_sample(own.where(F.col("label").isin(0, 1)), "label", "doc_id", n, per_class, 1)
    return docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select("label", "text"), n


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = EPOCHS) -> tuple[np.ndarray, float] | None:
    """Weights and bias, or None where there are not labels of both classes."""
    spark = docs.sparkSession
    bound_arrow(spark)
    rows, n = sample(docs, labels, per_class)
    rows = stage(rows, "labelled")
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not count.get(0) or not count.get(1):
        drop_staged(rows)
        return None
    share = count[1] / (count[0] + count[1])
    seen = rows.mapInArrow(_counted, "feature int, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    deviation = F.abs(F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    telling = np.array(sorted(r["feature"] for r in seen.where((F.col("n") >= LEAST_DOCS) & (deviation >= DEVIATIONS)).select("feature").collect()), np.int64)
    weight = np.zeros(DIMS, np.float32)
    if not len(telling):
        drop_staged(rows)
        return weight, -30.0
    got = rows.mapInArrow(_packed(spark.sparkContext.broadcast(telling)), "label int, sentences int, sentence binary, feature binary").collect()
    drop_staged(rows)
    w, b = _fit(sorted(tuple(r) for r in got), len(telling), n[0] / n[1], epochs)
    weight[telling] = w
    return weight, b


def _fit(rows: list[tuple[int, int, bytes, bytes]], dims: int, ratio: float, epochs: int) -> tuple[np.ndarray, float]:
    """Adaptive gradient steps on the cross-entropy of noisy-or; ``ratio``: documents of label 0 for each of label 1."""
    got = [(x[1], np.frombuffer(x[2], np.int32), np.frombuffer(x[3], np.int32)) for x in rows]
    y = np.array([x[0] for x in rows], np.float64)
    heavy = min(5.0, max(1.0, ratio * y.sum() / (1 - y).sum()))
    w, b = np.zeros(dims), -4.0
    square, square_b = np.full(dims, 1e-2), 1e-2
    order = np.random.Generator(np.random.PCG64(11))
    for _ in range(epochs):
        by = order.permutation(len(y))
        for a in range(0, len(by), 64):
            own = by[a : a + 64]
            size = [got[i][0] for i in own]
            base = np.concatenate([[0], np.cumsum(size)])
            if not base[-1]:
                continue
            s = np.concatenate([got[i][1] + base[k] for k, i in enumerate(own)]).astype(np.int64)
            f = np.concatenate([got[i][2] for i in own])
            doc = np.repeat(np.arange(len(own)), size)
            z = b + (np.bincount(s, w[f], base[-1]) if len(f) else 0.0) * np.ones(base[-1])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(own)))
            t, cost = y[own], np.where(y[own] > 0, 1.0, heavy)
            g = (np.where(t > 0, -none / np.maximum(1 - none, 1e-6), 1.0) * cost)[doc] * p
            gw = np.bincount(f, g[s], dims) if len(f) else np.zeros(dims)
            square += gw * gw
            w -= 0.3 * gw / np.sqrt(square)
            gb = g.sum()
            square_b += gb * gb
            b -= 0.3 * gb / np.sqrt(square_b)
    return w, float(b)


def _scores(model, least: float):
    def run(batches):
        w, b = model.value if model.value is not None else (None, 0.0)
        for batch in small_batches(batches):
            texts = binary(batch.column("text"))
            s = Sentences(texts)
            if w is None:
                p = np.zeros(len(s.doc))
            else:
                p = 1 / (1 + np.exp(-np.clip(b + np.bincount(s.sentence, w[s.feature], len(s.doc)), -30, 30)))
            none = np.bincount(s.doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts))
            found: list[list[dict]] = [[] for _ in texts]
            for k in np.flatnonzero(p >= least):
                d = int(s.doc[k])
                a, e = int(s.start[k] - s.words.offset[d]), int(s.end[k] - s.words.offset[d])
                start = len(texts[d][:a].decode())
                found[d].append({"start": start, "end": start + len(texts[d][a:e].decode()), "score": float(p[k])})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            n = np.bincount(s.doc, minlength=len(texts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(-np.expm1(none)), pa.array(n), pa.array(found, kind)], ["doc_id", "score", "sentences", "offending"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, per_class: int = PER_CLASS, sentence_least: float = 0.5) -> DataFrame:
    """(doc_id, score, sentences, offending): offending has the code-point spans of sentences scored at least ``sentence_least``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs if train_docs is None else train_docs, labels, per_class))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(model, sentence_least), RESULT)


def op1_toxicity_mil(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(bucket_of("doc_id", 3) != 1)
    scored = toxicity(docs, labels)
    return scored.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score under the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    shape = docs.select(rest).schema

    def keep(batches):
        for batch in small_batches_of_struct(batches):
            inner = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("row").field("text")], ["doc_id", "text"])
            score = np.concatenate([x.column("score").to_numpy() for x in _scores(model, 2.0)([inner])]) if batch.num_rows else np.empty(0)
            yield batch.filter(pa.array(score < threshold))

    return docs.select(rest).mapInArrow(keep, shape).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def small_batches_of_struct(batches, limit: int = 2 << 20):
    for batch in batches:
        yield from small_batches([batch], limit, text=batch.column("row").field("text"))
