"""Mixing, packing, rules, licenses and the pipeline."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from oracle import differences
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanlens.llm import license as lic
from spanlens.llm import mixing, packing, quality, registry, simhash, substring, toxicity


def wanted(sizes: dict) -> dict:
    """Targets by source, from the definition."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, live, total = {}, list(names), float(sum(sizes.values()))
    while live:
        unit = total / sum(weight[s] for s in live)
        over = [s for s in live if unit * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in live}
        for s in over:
            out[s] = 3.0 * sizes[s]
            total -= out[s]
            live.remove(s)
    return out


def check_mix(rows, docs):
    size = {d: len(brute.words(t)) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    by = defaultdict(int)
    for d, s in source.items():
        by[s] += size[d]
    targets = wanted(by)
    taken = defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], by[s])
        assert r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)


def test_mix_of_the_table(spark, sf, documents):
    docs = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    rows = registry.QUERIES["op3_mixing_flow"](spark, sf).collect()
    assert len(rows) == len(docs)
    check_mix(rows, docs)
    assert sorted(rows) == sorted(registry.QUERIES["op3_mixing_flow"](spark, sf).collect())


def test_odd_mix(clashing, odd_rows, no_docs):
    rows = mixing.mix(clashing).collect()
    assert len(rows) == len(odd_rows)
    check_mix(rows, [(r[0], r[1], r[3]) for r in odd_rows])
    assert mixing.mix(no_docs).collect() == []
    assert mixing.apply_mix(no_docs).collect() == []


def test_mixed_texts_have_the_words_taken(odd_docs, clashing):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(odd_docs).collect()}
    out = mixing.apply_mix(odd_docs)
    assert out.columns == odd_docs.columns
    assert mixing.apply_mix(clashing).columns == clashing.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += len(brute.words(r["text"]))
        assert r["text"] is None or not brute.words(r["text"]) or r["n_chars"] is not None
    assert all(got[d] == t for d, t in taken.items())


def test_equal_rows_share_what_is_taken(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, "d e f g h", "y")], "doc_id long, text string, source string")
    taken = mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("t")).collect()
    out = defaultdict(int)
    for r in mixing.apply_mix(docs).collect():
        out[r["doc_id"]] += len(brute.words(r["text"]))
    assert {r["doc_id"]: r["t"] for r in taken} == dict(out)


def test_columns_of_any_name_come_back(spark, clashing, odd_docs):
    """Filtering stages hand on every column as it was, whatever its name."""
    import corpus_pipeline

    extra = [c for c in clashing.columns if c not in odd_docs.columns]
    for name, step in corpus_pipeline.STAGES[1:4]:
        plain = sorted(str(tuple(r)) for r in step(spark, odd_docs, "").collect())
        out = step(spark, clashing, "")
        assert out.columns == clashing.columns, name
        rows = out.collect()
        assert sorted(str(tuple(r[c] for c in odd_docs.columns)) for r in rows) == plain, name
        assert all(r[c] == f"own {c}" for r in rows for c in extra), name


def test_many_sources(spark):
    """Any number of sources that don't overlap: each comes near its target."""
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 25_000:05d}") for i in range(50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(mixing.mix(docs).collect(), rows)


def test_flow_beside_sources_of_their_own():
    """What needs no flow gets the same as in one flow of all."""
    sums = [((0,), 10), ((0, 1), 6), ((1,), 3), ((2,), 8), ((3,), 2)]
    quotas = [14, 9, 5, 6]
    whole = [sum(x.values()) for x in mixing.flow([(frozenset(own), n) for own, n in sums], quotas)]
    assert mixing.solve(sums, quotas) == whole
    assert mixing.solve(sums[3:], quotas) == whole[3:]


def cheapest(patterns, quotas, repeats=3):
    """The least cost of the largest flow, by trying everything."""
    ways = []
    for sources, n in patterns:
        own = sorted(sources)
        ways.append([dict(zip(own, x, strict=True)) for x in itertools.product(range(repeats * n + 1), repeat=len(own)) if sum(x) <= repeats * n])
    best = None
    for pick in itertools.product(*ways):
        into = [sum(p.get(s, 0) for p in pick) for s in range(len(quotas))]
        if any(i > q for i, q in zip(into, quotas, strict=True)):
            continue
        cost = 0
        for p, (_, n) in zip(pick, patterns, strict=True):
            left = sum(p.values())
            for r in range(repeats):
                cost += min(n, left) * r * r
                left -= min(n, left)
        mark = (-sum(into), cost)
        best = mark if best is None else min(best, mark)
    return best


@pytest.mark.parametrize(
    ("patterns", "quotas"),
    [([(frozenset({0}), 2), (frozenset({0, 1}), 2), (frozenset({1}), 1)], [4, 4]), ([(frozenset({0, 1}), 3)], [2, 5]), ([(frozenset({0}), 1), (frozenset({1}), 3)], [5, 2]), ([(frozenset(), 2), (frozenset({0}), 0)], [3])],
)
def test_flow_is_the_cheapest(patterns, quotas):
    sent = mixing.flow(patterns, quotas)
    into = [sum(x.get(s, 0) for x in sent) for s in range(len(quotas))]
    assert all(i <= q for i, q in zip(into, quotas, strict=True))
    cost = 0
    for x, (_, n) in zip(sent, patterns, strict=True):
        left = sum(x.values())
        assert left <= 3 * n
        for r in range(3):
            cost += min(n, left) * r * r
            left -= min(n, left)
    assert (-sum(into), cost) == cheapest(patterns, quotas)


def test_overlapping_sources(spark):
    rows = [(i, " ".join(["w"] * (i % 5 + 1)), ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", "c"]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of array<string>")
    out = mixing.mix(docs.withColumn("source", F.lit("x")), members="of").collect()
    assert len(out) == 60 and all(0 <= r["taken"] <= 3 * r["size"] for r in out)


def check_pack(rows, docs, whole=2048):
    """Every id in one piece, sequences gapless from 0 and full or a power of two."""
    t = Tokenizer.from_file(packing.default_path())
    want = defaultdict(list)
    for d, text in docs:
        want[d].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for d, texts in want.items():
        assert sum(r["length"] for r in pieces[d]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r["start"]):
                ids = texts[0][at : at + r["length"]]
                assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(ids.tobytes()), len(texts[0]))
                at += r["length"]
    total = padded = 0
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= whole
        total += at
        padded += at if at & (at - 1) == 0 else whole
    return 1 - total / max(1, padded)


def test_pack_of_the_table(spark, sf, doc_rows):
    assert check_pack(registry.QUERIES["op4_packing_nnls"](spark, sf).collect(), doc_rows) < 0.02


def test_odd_pack(clashing, odd_rows, no_docs):
    check_pack(packing.pack(clashing, packing.default_path()).collect(), [r[:2] for r in odd_rows])
    assert packing.pack(no_docs, packing.default_path()).collect() == []


def test_pack_repeated_rows_and_null_ids(spark):
    rows = [(1, "one two three")] * 5 + [(None, "x")] * 3 + [(2, "<|endoftext|> it's <|startoftext|> İ ﬁ Á don't n't 12 I'LL")]
    check_pack(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), packing.default_path()).collect(), rows)


def test_ids_of_odd_texts(monkeypatch, doc_rows):
    """Slices, a small memory of pieces and texts cut in parts give the tokenizer's own ids."""
    t = Tokenizer.from_file(packing.default_path())
    odd = ["<|endoftext|> it's <|startoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|>", "<|endoftext|" + ">" * 3, "x\xa0y\u3000z", "e\u0301a caf\u00e9", "", " \t", "\x1cfoo\x1dbar\x7f"]
    odd += ["\u6f22\u5b57!?12", "\u01c4 \u00df \u1e9e \u0130stanbul \u00d7\u00f7 \u00dd\u00fe", "'s's 're I'LL", "#$%^&*()", "a" * 5000, "x" * 70 + " " + "x" * 70, "3.14,15"]
    texts = [t or "" for _, t in doc_rows[:60]] + odd
    want = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    for limit in (packing.CACHE_BYTES, 20_000):
        monkeypatch.setattr(packing, "CACHE_BYTES", limit)
        own = packing.WordIds(packing.default_path())
        for _ in range(2):
            for a in range(0, len(texts), 7):
                ids, edge = own.ids([x.encode() for x in texts[a : a + 7]])
                assert [ids[x:y].tolist() for x, y in itertools.pairwise(edge)] == want[a : a + 7]
        assert [own.long_ids(x.encode(), 100).tolist() for x in odd] == want[60:]


@pytest.mark.parametrize("seed", range(3))
def test_least_squares(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, (6, 9)).astype(float), rng.random(6)
    x = packing.nnls(a, b)
    w = a.T @ (b - a @ x)
    assert (x >= 0).all() and (w <= 1e-7).all() and np.abs(w[x > 1e-9]).max(initial=0) < 1e-7


def test_plan_takes_no_more_than_there_is():
    have = np.bincount(np.random.default_rng(1).integers(1, 65, 5000), minlength=65)
    used = np.zeros(65, int)
    for combo, n in packing.plan(have, 64):
        assert sum(combo) == 64 and n > 0
        for c in combo:
            used[c] += n
    assert (used <= have).all() and used.sum() > 0.9 * have.sum()


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check_rules(rows, docs):
    want = {d: brute.quality(t) for d, t in docs}
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[c] for c in BASE) == want[r["doc_id"]], r["doc_id"]
        assert not (r["kept"] and r["base_failed"])


def test_rules_of_the_table(spark, sf, doc_rows):
    check_rules(registry.QUERIES["op10_quality_rules"](spark, sf).collect(), doc_rows)


def test_odd_rules(clashing, odd_rows, no_docs):
    check_rules(quality.quality(clashing).collect(), [r[:2] for r in odd_rows])
    assert quality.quality(no_docs).collect() == []
    assert "Python" not in quality.quality(clashing)._jdf.queryExecution().toString()


def test_each_rule(spark):
    plain = "the cat and dog of this place " * 3
    fill = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{plain}{fill}"[:400]), (2, "word " * 3), (3, " ".join(f"# {x}" for x in fill.split())), (4, "\n".join([f"w{i}" for i in range(12)] + ["same line"] * 12)), (5, " ".join(f"{'x' * 30}{i}" for i in range(20)))]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] is got[3] is got[4] is got[5] is False
    only = (quality.Rule("n_words", least=3),)
    assert {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), only).collect()}[5] is True


def contained(text, template, least=0.8):
    """Whether a window as long as the template has enough of its shingles."""
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.lower(t))
    w, t = split(text or ""), split(template)
    k = min(5, len(t))
    want = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    return any(len(want & {tuple(w[j : j + k]) for j in range(i, i + len(t) - k + 1)}) >= least * len(want) for i in range(len(w) - len(t) + 1))


def test_licenses_of_the_table(spark, sf, doc_rows):
    got = {r["doc_id"]: r["licenses"] for r in registry.QUERIES["op7_license_minhash"](spark, sf).collect()}
    assert len(got) == len(doc_rows)
    for d, text in doc_rows:
        assert got[d] == ",".join(sorted(n for n, t in lic.TEMPLATES.items() if contained(text, t))), d


def test_license_spans(clashing, no_docs, spark):
    body = lic.TEMPLATES["BSD-text"]
    words = body.split()
    near = " ".join([*words[:4], "sourcecode", *words[5:]])
    far = " ".join(w if i % 4 else "zzz" for i, w in enumerate(words))
    rows = [(1, f"é 😀 intro. {body} outro"), (2, f"x {near} y"), (3, far), (4, None), (5, "Licensed under CC BY 4.0"), (6, f"{body} {body}")]
    got = {r["doc_id"]: r["matches"] for r in lic.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [rows[0][1][m["start"] : m["end"]] for m in got[1]] == [body] and got[1][0]["containment"] == 1.0
    assert bool(got[2]) == contained(near, body) and not got[3] and not got[4]
    assert [m["license"] for m in got[5]] == ["CC-BY-4.0"] and len(got[6]) == 2
    assert len(lic.license_matches(clashing).collect()) == clashing.count() and lic.license_matches(no_docs).collect() == []


def test_notice_line_of_the_documents(spark, sf, doc_rows):
    got = {r["doc_id"]: r["licenses"].split(",") for r in registry.QUERIES["op7_license_minhash"](spark, sf).collect()}
    lined = {d for d, t in doc_rows if re.search(r"(?m)^All rights reserved\.$", t or "")}
    assert {d for d, names in got.items() if "all-rights-reserved" in names} >= lined
    found = lic.scan(lic.Templates(lic.TEMPLATES), ["Some prose.\nAll rights reserved.".encode(), b"All of the rights reserved"])
    assert [[(m["license"], m["start"], m["end"]) for m in x] for x in found] == [[("all-rights-reserved", 12, 31)], []]


def test_inserted_words_are_part_of_the_window():
    """Containment over the whole text decides, wherever a few words stand in the template."""
    templates = lic.Templates(lic.TEMPLATES)
    words = re.findall("[a-z]+", lic.TEMPLATES["GPL-text"].lower())
    want = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    for many in (1, 2, 3):
        for at in range(1, len(words)):
            body = " ".join([*words[:at], *["zzz"] * many, *words[at:]])
            own = body.split()
            share = len(want & {tuple(own[i : i + 5]) for i in range(len(own) - 4)}) / len(want)
            text = f"some words before {body} and some after"
            found = [m for m in lic.scan(templates, [text.encode()])[0] if m["license"] == "GPL-text"]
            assert share >= 0.8 and [m["containment"] for m in found] == [pytest.approx(share)], (many, at)
            assert text[found[0]["start"] : found[0]["end"]] in body


def test_registered_sql(spark, sf):
    for name, sql in registry.ORACLES.items():
        assert not differences(registry.QUERIES[name](spark, sf), sql, sf), name


def test_pipeline(spark, sf, documents):
    """Each stage against a plain version of its work on what the stage before kept."""
    import corpus_pipeline

    docs = documents
    kept = [docs]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        step(spark, docs, sf).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
        kept.append(docs)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents, labels).collect()}
    own = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    assert own(kept[1]) == [x for x in own(documents) if score[x[0]] < toxicity.THRESHOLD]
    groups = brute.simhash(own(kept[1]))
    assert own(kept[2]) == [x for x in own(kept[1]) if groups[x[0]][1] == x[0]]
    cut = {d: (n, lost, h) for d, n, lost, h in brute.dedup_words(own(kept[2]))}
    third = own(kept[3])
    assert {d for d, _ in third} == {d for d, (n, lost, _) in cut.items() if not lost or lost < n}
    check_mix(mixing.mix(kept[3]).collect(), [tuple(r) for r in kept[3].select("doc_id", "text", "source").collect()])
    check_pack(kept[5].collect(), own(kept[4]))


def test_stages_take_odd_rows(spark, sf, clashing, odd_docs, no_docs):
    import corpus_pipeline

    last = []
    for df in (clashing, odd_docs, no_docs):
        docs = df
        for _, step in corpus_pipeline.STAGES[:4]:
            docs = step(spark, docs, sf)
        assert docs.columns == df.columns
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        pieces = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
        check_pack(pieces, rows)
        last.append(sorted(map(str, rows)))
    assert last[0] == last[1] and len(last[1]) >= 5 and not last[2]


def test_modules_are_used():
    assert simhash.RADIUS == 3 and substring.WINDOW == 13
