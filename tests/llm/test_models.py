"""Trained operators: held-out accuracy, sums of probabilities and defined results."""

from __future__ import annotations

import itertools
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlens.llm import language, registry, suffixtree, toxicity


@pytest.fixture(scope="module")
def larger(sf):
    return sf.replace("sf0.001", "sf0.01")


def test_toxicity_held_out(spark, larger):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = registry.QUERIES["op1_toxicity_mil"](spark, larger).collect()
    assert len(rows) == spark.read.parquet(f"{larger}/documents.parquet").count()
    assert all(r["held_out"] == (brute.bucket(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    bad, fine = [s for t, s in held if t == 1], [s for t, s in held if t == 0]
    assert np.mean([x > y for x in bad for y in fine]) > 0.9
    assert np.mean([y >= 0.7 for y in fine]) < 0.03


def made_toxic(spark):
    rows, labels = [], []
    for i in range(300):
        text = f"The walk {i} was long. We saw {i % 7} birds. " + ("You vile wretch! " if i % 3 == 0 else "") + f"Rain came at {i % 5}."
        rows.append((i, text))
        labels.append((i, int(i % 3 == 0)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_offending_sentences(spark):
    rows, docs, labels = made_toxic(spark)
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    for i, text in rows:
        spans = [text[x["start"] : x["end"]] for x in out[i]["offending"]]
        assert spans == (["You vile wretch"] if i % 3 == 0 else []), (i, spans)
        assert out[i]["sentences"] == (4 if i % 3 == 0 else 3)
    kept = toxicity.reject_toxic(docs, labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if i % 3}


def test_toxicity_defined_results(spark, clashing, no_docs):
    _, docs, labels = made_toxic(spark)
    rows = {r["doc_id"]: r for r in toxicity.toxicity(clashing, labels, docs).collect()}
    assert rows[3]["score"] == rows[4]["score"] == rows[5]["score"] == 0 and rows[3]["offending"] == []
    assert toxicity.toxicity(no_docs, labels, docs).collect() == []
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(clashing, none).collect()} == {0.0}
    kept = toxicity.reject_toxic(clashing, labels)
    assert kept.columns == clashing.columns
    twice = docs.unionByName(docs)
    assert toxicity.reject_toxic(twice, labels).count() == 2 * toxicity.reject_toxic(docs, labels).count()


def test_language_held_out(spark, larger):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang").collect()}
    rows = registry.QUERIES["op6_language_hierarchy"](spark, larger).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (brute.bucket(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]] is not None]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.97


def test_close_languages(spark):
    """A family of three and one of its own: pairs within the family decide."""
    texts = {"es": "el perro corre por la calle y la noche", "pt": "o cachorro corre pela rua e a noite", "it": "il cane corre per la strada e la notte", "fi": "koira juoksee kadulla ja yö"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), x) for i, (x, t) in enumerate((x, t) for _ in range(40) for x, t in texts.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, docs).collect()}
    assert all(out[i] == x for i, _, x in rows)
    model = language.train(docs)
    assert model.families == ["romance", "uralic"] and len(model.pairs) == 3


def test_more_languages_than_common(spark):
    """All of 300 languages are learned and predicted."""
    rng = np.random.default_rng(9)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = {f"x{k:03d}": ["".join(rng.choice(letters, 6)) for _ in range(12)] for k in range(300)}
    rows = [(3 * k + i, " ".join(rng.choice(w, 30)), x) for k, (x, w) in enumerate(words.items()) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, docs).collect()}
    assert np.mean([out[i] == x for i, _, x in rows]) > 0.97 and len(set(out.values())) >= 295


def vote(z, model):
    """Family by the largest margin, then votes of pairs, from given margins."""
    best = int(np.argmax(z[: len(model.families)])) if len(model.families) > 1 else 0
    at = (len(model.families) if len(model.families) > 1 else 0) + sum(len(m) * (len(m) - 1) // 2 for m in model.members[:best])
    own = model.members[best]
    score = {x: 0.0 for x in own}
    for a, b in itertools.combinations(own, 2):
        p = 1 / (1 + np.exp(-2 * z[at]))
        score[a] += (z[at] >= 0) + p / (len(own) + 1)
        score[b] += (z[at] < 0) + (1 - p) / (len(own) + 1)
        at += 1
    return max(own, key=lambda x: (score[x], [-ord(c) for c in x]))


def test_votes_of_given_weights():
    """Predictions of a model with given weights against a plain count of features and votes."""
    model = language.Model(["es", "pt", "it", "en", "de", "fi"])
    rng = np.random.default_rng(12)
    model.weight = rng.normal(size=model.weight.shape).astype(np.float32)
    model.bias = rng.normal(size=model.bias.shape).astype(np.float32) * 0.1
    texts = ["el perro corre", "Der Hund, der läuft!", "koira 12 juoksee", "a", "", None, "the dog runs and runs and runs", "o cão"]
    got, score = model.predict(pa.array(texts))
    for k, t in enumerate(texts):
        f, _ = language.grams(pa.array([t], pa.string()))
        z = language.SCALE * model.weight[f].astype(np.float64).mean(axis=0) + model.bias
        assert got[k] == vote(z, model) and 0 <= score[k] <= 1


def test_noisy_or_of_given_weights(spark):
    """Scores of given weights against words, sentences and noisy-or written out."""
    import re

    weight = np.random.default_rng(13).normal(size=toxicity.DIMS).astype(np.float32)
    texts = ["You vile wretch! Go away. Now", "one line\nother line?", "", None, "...", "Word word WORD extraordinarily", "été: naïve, 12,5 and more\tof it!"]

    class Held:
        value = (weight, -1.5)

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    out = [r for b in toxicity._scores(Held, 0.5)([batch]) for r in b.to_pylist()]
    assert len(out) == len(texts)
    feature = lambda w, n: int(toxicity.Sentences([w]).words.hashes()[0] >> np.uint64(44)) if not n else int((toxicity.hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([n])) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))[0] >> np.uint64(44))
    for r, t in zip(out, texts, strict=True):
        none, n = 1.0, 0
        for sentence in re.split(r"[\n!.?]", brute.lower(t)):
            words = [w.encode() for w in re.split(r"[\x09-\x0d\x20-/:-@\[-`{-~]+", sentence) if w]
            if words:
                own = {feature(w, 0) for w in words} | {feature(w, k) for w in words for k in toxicity.BEGINNINGS if len(w) > k}
                none *= 1 - 1 / (1 + np.exp(1.5 - sum(float(weight[f]) for f in own)))
                n += 1
        assert (r["sentences"], r["score"]) == (n, pytest.approx(1 - none, abs=1e-9)), t


def test_samples_are_exact_and_ordered(spark):
    """The smallest hashes of each group, however the rows are dealt; fewer where there are fewer."""
    from spanlens.llm.shared import hashed_sample

    rows = spark.range(20_000).selectExpr("id", "case when id % 10 = 0 then 'a' when id = 5 then null else 'b' end as g")
    sizes = {"a": 2000, "b": 17_999, None: 1}
    got = None
    for k in (1, 7):
        own = [(r["id"], r["g"]) for r in hashed_sample(rows.repartition(k), "g", "id", sizes, 50, 3).collect()]
        assert {g: sum(x == g for _, x in own) for g in sizes} == {"a": 50, "b": 50, None: 1}
        got = got or sorted(i for i, _ in own)
        assert got == sorted(i for i, _ in own)


def test_language_defined_results(spark, clashing, no_docs):
    rows = {r["doc_id"]: r for r in language.identify(clashing, clashing).collect()}
    assert all((rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0) for i in (3, 4, 5))
    assert rows[13]["lang_pred"] != "und"
    assert language.identify(no_docs, clashing).collect() == []
    assert {r["lang_pred"] for r in language.identify(clashing, no_docs).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "12 34 !"), (2, "漢字")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(digits, clashing.where("lang = 'en'")).collect()} == {1: "und", 2: "en"}


def test_suffix_tree_of_the_table(spark, sf, doc_rows):
    want = brute.base_scores(doc_rows)
    got = registry.QUERIES["op8_suffix_tree"](spark, sf).collect()
    assert len(got) == len(doc_rows)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (brute.bucket(r["doc_id"], 5) == 1)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_add_up(spark, doc_rows):
    """After any context, the probabilities of all symbols and one unknown symbol make one."""
    docs = spark.createDataFrame(doc_rows, "doc_id long, text string")
    tree, single = suffixtree.train(docs)
    table = {r["key"]: r["n"] for r in single.collect()}
    hashes = np.array(sorted(table, key=lambda k: np.int64(k).view(np.uint64)), np.int64).view(np.uint64)
    n = np.array([table[int(h.view(np.int64))] for h in hashes], np.float64)
    sym = tree.symbols.of(hashes)
    base = np.concatenate([tree.base(n), [tree.base(np.zeros(1))[0]]])
    sym = np.concatenate([sym, [-1]])
    assert base.sum() == pytest.approx(1)
    assert len(tree.levels) >= 2 and all(len(x.entry) for x in tree.levels[:2])
    # states of real positions: all suffixes of what stands before them
    texts = [(t or "").encode() for _, t in doc_rows[:40]]
    h, doc = suffixtree._tokens(texts)
    at = suffixtree.states(tree.symbols.of(h), doc, tree.contexts)
    picked = np.flatnonzero(at[-1] >= 0)[:15].tolist() + np.flatnonzero(at[1] >= 0)[:15].tolist() + list(range(10))
    for i in picked:
        numbers = [np.full(len(sym), x[i]) for x in at]
        assert tree.probability(numbers, sym, base).sum() == pytest.approx(1, abs=1e-9)


def test_contexts_are_numbered_alike(spark, doc_rows):
    """Counts of what follows a context of three words, by its number, against a plain count."""
    texts = [(t or "").encode() for _, t in doc_rows]
    docs = spark.createDataFrame(doc_rows, "doc_id long, text string")
    tree, _ = suffixtree.train(docs, 3)
    h, doc = suffixtree._tokens(texts)
    grams = Counter((d, tuple(h[i - 3 : i].tolist())) for i, d in enumerate(doc) if i >= 3 and doc[i - 3] == d)
    times = Counter()
    for (_, g), n in grams.items():
        times[g] += n
    sym = tree.symbols.of(h)
    at = suffixtree.states(sym, doc, tree.contexts)
    for i in range(len(h)):
        if i >= 3 and doc[i - 3] == doc[i] and (sym[i - 3 : i] >= 0).all():
            assert (at[2][i] >= 0) == (times[tuple(h[i - 3 : i].tolist())] >= suffixtree.LEAST), i
        else:
            assert at[2][i] < 0


def test_deeper_contexts_help(spark):
    rows = [(i, "a x one. b x two. " * 30 + ("p q r s " if i % 2 else "o q r t ") * 20) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total = []
    for depth in (1, 2, 3):
        tree, _ = suffixtree.train(docs, depth)
        h, doc = suffixtree._tokens([t.encode() for _, t in rows])
        total.append(tree.log10(h, doc)[0].sum())
    assert total[0] < total[1] < total[2]


def test_gram_keys_are_undone():
    rng = np.random.default_rng(2)
    context, suffix = rng.integers(0, 2**64 - 1, size=(2, 1000), dtype=np.uint64)
    assert (suffixtree.context_of(suffixtree.pair(context, suffix), suffix) == context).all()


@pytest.mark.parametrize(("bits", "flush"), [(0, 4_000_000), (5, 50)])
def test_packed_counts(spark, doc_rows, monkeypatch, bits, flush):
    """Sums over slices, flushes and buckets are plain counts."""
    monkeypatch.setattr(suffixtree, "FLUSH", flush)
    docs = spark.createDataFrame(doc_rows[:40], "doc_id long, text string").repartition(3)
    h, doc = suffixtree._tokens([(t or "").encode() for _, t in doc_rows[:40]])
    both = np.flatnonzero(doc[:-1] == doc[1:])
    want = Counter(zip(h[both].view(np.int64).tolist(), h[both + 1].view(np.int64).tolist(), strict=True))
    got = suffixtree.packed_counts(docs, suffixtree._following(None, 1), bits, 2, True).collect()
    assert {(r["context"], r["suffix"]): r["n"] for r in got} == {k: n for k, n in want.items() if n >= 2} and len(got) > 10
    single = suffixtree.packed_counts(docs, lambda t: (suffixtree._tokens(t)[0], None), bits, 1, False).collect()
    assert {r["key"]: r["n"] for r in single} == Counter(h.view(np.int64).tolist())


def plain_tree(rows, trained, depth=3, least=3, divergence=3.0):
    """log10 of each text's probability by a suffix tree in dictionaries."""
    texts = {d: [*brute.words(brute.lower(t)), None] for d, t in rows}
    c = Counter(x for d in trained for x in texts[d])
    total, kinds = sum(c.values()), len(c)
    seen = {(x,): n for x, n in c.items() if n >= least}
    levels = []

    def probability(before, x):
        p = (c[x] + 0.5) / (total + 0.5 * (kinds + 1))
        for k, level in enumerate(levels, 1):
            if (own := level.get(tuple(before[-k:]))) and len(before) >= k:
                entries, weight = own
                p = (entries.get(x, 0) + weight * p) / (sum(entries.values()) + weight)
        return p

    for k in range(1, depth + 1):
        follow = {}
        for d in trained:
            w = texts[d]
            for i in range(k, len(w)):
                if tuple(w[i - k : i]) in seen and (k == 1 or tuple(w[i - k + 1 : i + 1]) in seen):
                    follow.setdefault(tuple(w[i - k : i]), Counter())[w[i]] += 1
        follow = {g: {x: n for x, n in e.items() if n >= least and c[x] >= least} for g, e in follow.items()}
        kept = {}
        for g, e in follow.items():
            if not e:
                continue
            n, sums = seen[g], min(sum(e.values()), seen[g])
            shorter = {x: probability(g[1:], x) for x in e}
            gain = sum(m * np.log(m / n / shorter[x]) for x, m in e.items())
            if n > sums:
                gain += (n - sums) * np.log((n - sums) / n / max(1 - sum(shorter.values()), 1e-12))
            if gain >= divergence:
                kept[g] = (e, n - sums + len(e))
        levels.append(kept)
        seen = {(*g, x): m for g, e in follow.items() for x, m in e.items()}
    return {d: sum(np.log10(probability(w[max(0, i - depth) : i], x)) for i, x in enumerate(w)) for d, w in texts.items()}


def test_scores_of_a_plain_tree(spark, doc_rows):
    """Scores of 200 documents against a tree of dictionaries that learns and scores word by word."""
    rows = doc_rows[:200]
    trained = [d for d, _ in rows if brute.bucket(d, 5) != 1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in suffixtree.score(docs, docs.where(suffixtree.bucket_of("doc_id", 5) != 1)).collect()}
    want = plain_tree(rows, trained)
    assert all(got[d] == pytest.approx(want[d], rel=1e-9, abs=1e-9) for d in want)


def test_suffix_tree_defined_results(spark, clashing, odd_rows, no_docs):
    out = {r["doc_id"]: r for r in suffixtree.score(clashing, clashing.where("doc_id % 5 <> 1")).collect()}
    assert len(out) == len(odd_rows)
    assert out[3]["n_tokens"] == out[4]["n_tokens"] == 1 and out[3]["score"] == out[4]["score"]
    assert suffixtree.score(no_docs, clashing).collect() == []
    blank = suffixtree.score(clashing, no_docs).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in blank} == {(0, 0)}
    assert all(r["base_score"] == pytest.approx(0) for r in blank)


def test_grams_cover_every_text():
    f, first = language.grams(pa.array(["abc", "", None, "é"]))
    assert len(first) == 4 and (np.diff(np.append(first, len(f))) > 0).all()


def test_features_of_many_short_texts(spark):
    """Documents and features are told apart in slices of thousands of short texts."""
    rows = [(i, "bad egg" if i % 50 == 0 else f"fine day {i % 3}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i, _ in rows], "doc_id long, toxic int")
    counted = docs.join(labels, "doc_id").selectExpr("toxic as label", "text").coalesce(1).mapInArrow(toxicity._counted, "feature int, n long, toxic long")
    n = {r["feature"]: (r["n"], r["toxic"]) for r in counted.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).collect()}
    of = lambda w: n[int(toxicity.Sentences([w.encode()]).feature[0])]
    assert of("bad") == of("egg") == (180, 180) and of("fine") == of("day") == (8820, 0)
    out = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert all((out[i] >= 0.7) == (i % 50 == 0) for i, _ in rows)


def test_rare_contexts_of_a_large_corpus(spark, monkeypatch):
    """What occurs a few times counts whatever the size of the corpus, by lookup and by join alike."""
    few = [(i, f"left{i % 5} right{i % 5}") for i in range(20)]
    docs = spark.createDataFrame([*few, *((i, "z " * 400_000) for i in range(20, 30))], "doc_id long, text string")
    out = {}
    for hot in (suffixtree.HOT, 0):
        monkeypatch.setattr(suffixtree, "HOT", hot)
        out[hot] = {r["doc_id"]: (r["base_score"], r["score"]) for r in suffixtree.score(docs.where("doc_id < 20"), docs).collect()}
        assert all(score > base + 5 for base, score in out[hot].values())
    first, second = out.values()
    assert all(first[i] == pytest.approx(second[i], rel=1e-9) for i in first)


def test_tables_agree_with_the_tree(spark, doc_rows, monkeypatch):
    docs = spark.createDataFrame(doc_rows, "doc_id long, text string")
    tree, single = suffixtree.train(docs)
    h, doc = suffixtree._tokens([(t or "").encode() for _, t in doc_rows])
    want = np.bincount(doc, tree.log10(h, doc)[0], len(doc_rows))
    monkeypatch.setattr(suffixtree, "HOT", 500)
    monkeypatch.setattr(suffixtree, "FILTER_BITS", 12)
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in suffixtree.score(docs, docs).collect()}
    assert [got[d] for d, _ in doc_rows] == pytest.approx(want.tolist(), abs=1e-6)
