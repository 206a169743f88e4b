"""Language identification in two steps: the family of languages, then one-versus-one linear support vector machines within it.

Features are hashed 3- and 4-byte runs of the lower-case text, in which everything that is not a letter is one space; a
document is the mean of its features, so texts of any length are on one scale. Families come from ``FAMILIES``; a language
that is not listed is a family of its own. All classifiers are columns of one weight matrix, so a text is read once.

Training takes at most ``PER_LANGUAGE`` documents of each language, those with the smallest hashes of doc_id, and of the other
families of a family at most about ``REST`` of these; all languages are learned, however many, and the driver holds the
texts of the sample and half a megabyte for each classifier. Prediction reads every whole text, of any length.

Defined results: of languages with equal votes, the one with more of the pairs' confidence is predicted, then the first by
name, and of equally likely families the first by name; null texts and texts without a letter are ``und`` with score 0; so is every text if nothing was learned;
with one learned language that language has score 1; rows of a repeated doc_id each get their row; an empty table
gives an empty table. Only ``doc_id``, ``text`` and, for training, ``lang`` are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.shared import bound_arrow, bucket_of, hashed_sample
from spanlens.llm.words import binary, small_batches

FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "semitic": "ar he mt am".split(),
    "indic": "hi bn ur mr pa gu ne".split(),
    "uralic": "fi et hu".split(),
}
BITS = 17
PER_LANGUAGE = 700
REST = 6000
SCALE = 30.0
EPOCHS = 6
LETTER = np.full(256, 32, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.split("-")[0].lower() in langs), lang)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of all texts, and where each text's begin; every text gives one at least, whatever texts stand beside it."""
    parts = [b" " + (t or b"") + b"   " for t in binary(pc.utf8_lower(texts))]
    raw = LETTER[np.frombuffer(b"".join(parts), np.uint8)]
    doc = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32) | (doc[1:] != doc[:-1])
    raw, doc = raw[keep].astype(np.uint32), doc[keep]
    if len(raw) < 4:
        return np.zeros(2 * len(parts), np.int64), np.arange(0, 2 * len(parts), 2)
    three = raw[:-2] | (raw[1:-1] << np.uint32(8)) | (raw[2:] << np.uint32(16))
    four = three[:-1] | (raw[3:] << np.uint32(24))
    shift = np.uint32(32 - BITS)
    out = np.empty(2 * len(raw), np.uint32)
    out[0 : 2 * len(three) : 2] = np.where(doc[:-2] == doc[2:], (three * np.uint32(2654435761)) >> shift, 0)
    out[1 : 2 * len(four) : 2] = np.where(doc[:-3] == doc[3:], ((four ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> shift, 0)
    out[2 * len(three) :: 2] = 0
    out[2 * len(four) + 1 :: 2] = 0
    return out.astype(np.int64), 2 * np.searchsorted(doc, np.arange(len(parts)))


class Model:
    """Weights (features x classifiers): one column a family, then one a pair of languages of one family."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(langs)
        self.families = sorted({family_of(x) for x in self.langs})
        self.members = [[x for x in self.langs if family_of(x) == f] for f in self.families]
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        self.tasks = ([({x for x in self.langs if family_of(x) == f}, {x for x in self.langs if family_of(x) != f}) for f in self.families] if len(self.families) > 1 else []) + [
            ({a}, {b}) for a, b in self.pairs
        ]
        self.weight = np.zeros((1 << BITS, len(self.tasks)), np.float32)
        self.bias = np.zeros(len(self.tasks), np.float32)

    def train(self, examples: list[tuple[str, np.ndarray]]) -> None:
        """Hinge loss by adaptive gradient steps, one classifier at a time."""
        rng = np.random.Generator(np.random.PCG64(5))
        for k, (yes, no) in enumerate(self.tasks):
            positive, negative = [(1.0, f) for x, f in examples if x in yes], [(-1.0, f) for x, f in examples if x in no]
            own = positive + negative[:: max(1, -(-len(negative) // max(REST, 1)))]
            up = sum(y > 0 for y, _ in own) / max(1, len(own))
            w, square, b, square_b = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), 0.0, 1e-8
            mean = np.zeros(1 << BITS)
            for epoch in range(EPOCHS):
                by = rng.permutation(len(own))
                for a in range(0, len(by), 32):
                    part = [own[i] for i in by[a : a + 32]]
                    f = np.concatenate([x for _, x in part])
                    size = np.array([len(x) for _, x in part])
                    doc = np.repeat(np.arange(len(part)), size)
                    y = np.array([v for v, _ in part])
                    z = SCALE * np.bincount(doc, w[f], len(part)) / size + b
                    g = np.where(y * z < 1, -y * np.where(y > 0, 0.5 / up, 0.5 / (1 - up)) if 0 < up < 1 else -y, 0.0)
                    gw = SCALE * np.bincount(f, (g / size)[doc], 1 << BITS)
                    hit = np.flatnonzero(gw)
                    gw = gw[hit] + 1e-4 * w[hit]
                    square[hit] += gw * gw
                    w[hit] -= 0.1 * gw / np.sqrt(square[hit])
                    gb = g.sum()
                    square_b += gb * gb
                    b -= 0.1 * gb / np.sqrt(square_b)
                if epoch >= EPOCHS // 2:
                    mean += w
            self.weight[:, k] = mean / (EPOCHS - EPOCHS // 2)
            self.bias[k] = b

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs or not n:
            return ["und"] * n, np.zeros(n)
        if len(self.langs) == 1:
            return [self.langs[0]] * n, np.ones(n)
        f, first = grams(texts)
        size = np.diff(np.concatenate([first, [len(f)]]))
        z = SCALE * np.add.reduceat(self.weight[f], first, axis=0, dtype=np.float64) / size[:, None] + self.bias
        many = len(self.families) > 1
        fam = z[:, : len(self.families)] if many else np.zeros((n, 1))
        e = np.exp(2 * (fam - fam.max(axis=1, keepdims=True)))
        share = e / e.sum(axis=1, keepdims=True)
        best = fam.argmax(axis=1)
        out, score = np.empty(n, object), share[np.arange(n), best]
        at = len(self.families) if many else 0
        for k, members in enumerate(self.members):
            rows = np.flatnonzero(best == k)
            votes = np.zeros((len(rows), len(members)))
            soft = np.zeros((len(rows), len(members)))
            for a, b in combinations(range(len(members)), 2):
                m = z[rows, at]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                p = 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
                soft[:, a] += p
                soft[:, b] += 1 - p
                at += 1
            top = (votes + soft / (len(members) + 1)).argmax(axis=1)
            out[rows] = np.array(members, object)[top]
            if len(members) > 1:
                score[rows] *= soft[np.arange(len(rows)), top] / (len(members) - 1)
        return out.tolist(), score


def snippet(text: str, seed: int) -> str:
    """A few words of a text, so that short texts are learned from too."""
    words = text.split()
    n = 3 + seed % 12
    a = seed // 12 % max(1, len(words) - n)
    return " ".join(words[a : a + n])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from ``lang`` and ``text`` of at most ``per_language`` documents of each language, those with the smallest hashes of doc_id."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    count = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    model = Model(list(count))
    if len(count) < 2:
        return model
    rows = sorted((r["lang"], r["text"]) for r in hashed_sample(known, "lang", "doc_id", count, per_language, 2).select("lang", "text").collect())
    rows += [(x, snippet(t, i * 7919)) for i, (x, t) in enumerate(rows)]
    examples = []
    for x, t in rows:
        examples.append((x, grams(pa.array([t]))[0].astype(np.int32)))
    model.train(examples)
    return model


def identify(docs: DataFrame, train_docs: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``, learned from ``train_docs``."""
    bound_arrow(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(train_docs))

    def run(batches):
        for batch in small_batches(batches):
            text = batch.column("text").cast(pa.string())
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang, score = model.value.predict(text)
            lang = [x if y else "und" for x, y in zip(lang, letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_hierarchy(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, docs.where(bucket_of("doc_id", 4) != 2))
    return out.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
