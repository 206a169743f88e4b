"""Vectors, fingerprints, components and substrings against plain versions."""

from __future__ import annotations

import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlens.llm import covertree, registry, simhash, substring
from spanlens.llm.components import components


def vectors(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_vectors_of_the_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert vectors(registry.QUERIES["op2_cover_tree"](spark, sf)) == brute.near_vectors(rows)


@pytest.mark.parametrize(("shard", "sample"), [(covertree.SHARD, covertree.SAMPLE), (40, 100)])
def test_odd_vectors(spark, monkeypatch, shard, sample):
    monkeypatch.setattr(covertree, "SHARD", shard)
    monkeypatch.setattr(covertree, "SAMPLE", sample)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    near = [(base[i % 12] + rng.normal(size=8) * 0.25).tolist() for i in range(150)]
    rows = [(i, v) for i, v in enumerate(near)]
    rows += [(500 + i, near[0]) for i in range(30)]
    rows += [(600, None), (601, []), (602, [0.0] * 8), (603, [1.0, None] + [0.0] * 6), (604, [float("nan")] * 8), (605, [float("inf")] + [0.0] * 7), (606, [1.0, 0.0]), (607, [2.0, 0.0]), (608, (1e-3 * base[0]).tolist())]
    rows += [(610, [1e200, 0.0, 0.0]), (611, [3e-200, 0.0, 0.0]), (612, [1e200, 1e199, 0.0]), (613, [0.0, 5e-324, 0.0]), (614, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "weight": F.lit("w"), "n": F.lit(None), "cell": F.lit(2), "root": F.lit(3)})
    got = covertree.near_vectors(df)
    assert got.count() == len(rows)
    assert vectors(got) == brute.near_vectors(rows)


def test_cosines_at_the_threshold(spark):
    """A cosine of 0.9 in double precision links, one a step below doesn't, whatever the length of the vectors."""
    rows = [(i, [9.0 * k, float(np.sqrt(19.0)) * k]) for i, k in enumerate((1.0, 3.0, 7e-5, 1e9))] + [(10, [1.0, 0.0]), (11, [5.0, 0.0])]
    rows += [(20, [9.0, float(np.nextafter(np.sqrt(19.0), 9)) * (1 + 4e-16)]), (21, [0.9, 0.4358898943540673])]
    assert vectors(covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute.near_vectors(rows)


def tree_of(x):
    w = np.ones(len(x), np.int64)
    return covertree.Links(tree := covertree.Tree(x), w, x, None, w, x, 0.9).run(), tree


def test_tree_levels_are_nested_and_halve():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 32))
    x = base[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 32)) * 0.2
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    links, t = tree_of(x)
    inner = np.flatnonzero(t.last)
    assert len(inner) > 60 and sorted(t.order) == list(range(2000))
    for k in inner:
        below = np.arange(t.first[k], t.last[k])
        rows = t.order[t.low[k] : t.high[k]]
        assert t.center[t.first[k]] == t.center[k] and (t.radius[below] <= t.reach[k] + 1e-9).all() and t.radius[k] / 2 <= t.reach[k] + 1e-9 < t.radius[k] + 2e-9
        assert np.sqrt(((x[rows] - x[t.center[k]]) ** 2).sum(axis=1)).max() <= t.radius[k] + 1e-7
    assert all(t.rows[k] == 1 or t.radius[k] <= covertree.SLACK for k in np.flatnonzero(t.last == 0))
    hit = x @ x.T >= 0.9
    assert (links.counts()[0] == hit.sum(axis=1) - 1).all()


def test_groups_are_pruned():
    """In groups about 0.95 alike, a small part of all pairs is compared; in one tight group next to none."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 64))
    base /= np.sqrt((base * base).sum(axis=1, keepdims=True))
    for groups, wide, share in ((60, 0.028, 0.1), (2, 0.01, 0.01)):
        x = base[rng.integers(0, groups, 3000)] + rng.normal(size=(3000, 64)) * wide
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        links, tree = tree_of(x)
        hit = x @ x.T >= 0.9
        assert (links.counts()[0] == hit.sum(axis=1) - 1).all()
        assert links.tested < share * len(x) ** 2 and (tree.last > 0).sum() > groups
        half = covertree.Links(covertree.Tree(x[:1000]), np.ones(1000, np.int64), x[:1000], covertree.Tree(x[1000:]), np.ones(2000, np.int64), x[1000:], 0.9).run()
        assert all((got == want).all() for got, want in zip(half.counts(), (hit[:1000, 1000:].sum(axis=1), hit[:1000, 1000:].sum(axis=0)), strict=True))


def test_vectors_visit_near_cells_only(monkeypatch):
    """Of shards of grouped vectors, a vector visits few, and those that hold its neighbours."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(100, 64))
    x = base[rng.integers(0, 100, 8000)] + rng.normal(size=(8000, 64)) * 0.2
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    top = covertree.Top(x[:1000])
    cell, far = top.home(x)
    cells = np.unique(cell)
    top.measure(cells, np.array([(cell == c).sum() for c in cells]), np.array([far[cell == c].max() for c in cells]), 200)
    own = top.first_shard[cell] + np.arange(len(x)) % top.blocks[cell]
    seen = np.zeros((len(x), top.shards), bool)
    for c, rows in top.visits(x, float(np.sqrt(0.2))):
        for s in range(top.first_shard[c], top.first_shard[c] + top.blocks[c]):
            seen[rows, s] = True
    assert seen[np.arange(len(x)), own].all() and seen.mean() < 0.1
    near = np.argwhere(x[:300] @ x.T >= 0.9)
    assert all(seen[i, own[j]] for i, j in near)
    shards = np.arange(top.shards)
    assert all((covertree.visits(shards, s) ^ np.array([covertree.visits(np.array([s]), int(k))[0] for k in shards]) == (shards != s)).all() for s in shards)


def test_dealing_is_bounded_in_memory():
    """Random vectors, which all visit nearly all cells: neither the way down, nor the visits, nor a batch that leaves grows with cells or shards."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(8000, 64)).astype(np.float32)
    x[1:400:2] = x[0:400:2] + 0.2 * rng.normal(size=(200, 64))
    unit = covertree.units([v.tobytes() for v in x], 64, "<f4")[1]
    top = covertree.Top(unit[-5000:])

    def peak(f):
        tracemalloc.start()
        try:
            return f(), tracemalloc.get_traced_memory()[1] / 2**20
        finally:
            tracemalloc.stop()

    (cell, far), mb = peak(lambda: top.home(unit))
    assert mb < 100  # distances of all rows to all cells: 305 MB
    cells, count = np.unique(cell, return_counts=True)
    most = np.zeros(len(top.centers))
    np.maximum.at(most, cell, far)
    top.measure(cells, count, most[cells], 20)
    near = float(np.sqrt(0.2))
    shard = top.first_shard[cell]
    batch = pa.RecordBatch.from_pydict({"node": np.arange(2000), "weight": np.ones(2000, np.int64), "data": [v.tobytes() for v in x[:2000]], "shard": pa.array(shard[:2000].astype(np.int32))})
    shared = type("Shared", (), {"value": (top, near)})
    deal = covertree._deal(shared, 64, "<f4", 0, top.shards, [1] * top.shards)
    out, mb = peak(lambda: [(b.nbytes, [(r["shard"], r["kind"], np.frombuffer(r["nodes"], np.int64), len(r["data"])) for r in b.to_pylist()]) for b in deal(iter([batch]))])
    assert top.shards > 300 and mb < 150 and len(out) > 5 and max(n for n, _ in out) < 1.2 * covertree.ARROW_BYTES
    met = set()
    for _, rows in out:
        for s, kind, nodes, size in rows:
            assert size == 256 * len(nodes) and (shard[nodes] == s).all() == (kind == 0)
            met |= {(int(i), s) for i in nodes}
    pairs = np.argwhere(np.triu(unit[:2000] @ unit[:2000].T >= 0.9, 1))
    assert len(pairs) > 100 and all((i, shard[j]) in met or (j, shard[i]) in met for i, j in pairs.tolist())


def test_visits_in_rounds(spark, monkeypatch):
    """Shards in rounds and visitors in parts give what one round gives; a round's copies stay near the table's bytes."""
    for name, v in (("SHARD", 40), ("SAMPLE", 100), ("ROUND", 1), ("PART", 60)):
        monkeypatch.setattr(covertree, name, v)
    plans = []
    real = covertree.Top.rounds
    monkeypatch.setattr(covertree.Top, "rounds", lambda *a: plans.append((a[0].shards, real(*a))) or plans[-1][1])
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 32))
    rows = [(i, (base[i % 150] + rng.normal(size=32) * 0.25).tolist()) for i in range(500)]
    assert vectors(covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute.near_vectors(rows)
    ((shards, rounds),) = plans
    assert len(rounds) > 2 and [s for a, b, _ in rounds for s in range(a, b)] == list(range(shards))
    assert all(len(parts) == b - a for a, b, parts in rounds) and max(max(parts) for _, _, parts in rounds) > 1


def test_long_vectors_have_smaller_samples_and_shards(spark, monkeypatch):
    monkeypatch.setattr(covertree, "WIDE", 8 * 8 * 30)
    seen = []
    real = covertree.Top.measure
    monkeypatch.setattr(covertree.Top, "measure", lambda self, cells, count, far, shard: (seen.append((len(self.tree.x), shard)), real(self, cells, count, far, shard)))
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 8))
    rows = [(i, (base[i % 20] + rng.normal(size=8) * 0.25).tolist()) for i in range(200)]
    assert vectors(covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute.near_vectors(rows)
    assert seen == [(30, 30)]


def test_no_vectors(spark):
    assert covertree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_repeated_and_null_vector_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in covertree.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)], key=str)


def prints(df):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()}


def test_fingerprints_of_the_table(spark, sf, doc_rows):
    assert prints(registry.QUERIES["op9_simhash_bktree"](spark, sf)) == brute.simhash(doc_rows)


def test_odd_fingerprints(clashing, odd_rows):
    assert prints(simhash.near_duplicates(clashing)) == brute.simhash([r[:2] for r in odd_rows])


def test_no_fingerprints(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.deduplicate(no_docs).collect() == []


def test_one_of_each_group_stays(odd_docs, odd_rows):
    want = {r[0] for r in odd_rows if brute.simhash([x[:2] for x in odd_rows])[r[0]][1] == r[0]}
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == want


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z w"), (None, "x y z w")], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 5
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (None, 1), (None, None)}
    assert sorted(str(r["doc_id"]) for r in simhash.deduplicate(docs).collect()) == ["1", "None"]


def test_one_text_of_each_group_stays(spark):
    """Groups without ids, ids in several groups, and copies without an id of a text that has one."""
    rows = [(None, "x y z w"), (None, "x y z w"), (None, "k l m n o"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (1, "q r s t u v"), (2, "q r s t u v"), (None, None)]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={d}, text={t!r})" for d, t in [(None, "x y z w"), (None, "k l m n o"), (1, "a b c d"), (1, "q r s t u v"), (None, None)])


@pytest.mark.parametrize("hot", [20_000, 3])
def test_links_within_the_radius(spark, hot):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    values = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(20)} | {0, 2**64 - 1, 7, 1})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    edges = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), hot=hot)
    at = {s: i for i, s in enumerate(signed)}
    got = brute.components(len(values), [(at[r["a"]], at[r["b"]]) for r in edges.collect()])
    want = brute.components(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3])
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components(41, edges)
    assert all(got.get(i, i) == want[i] for i in range(41))


def test_components_of_a_path(spark):
    edges = spark.range(3000).selectExpr("id * 7919 % 3001 as a", "(id + 1) * 7919 % 3001 as b")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert len(got) == 3000 and set(got.values()) == {0}


def cut(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_substrings_of_the_table(spark, sf, doc_rows):
    assert cut(registry.QUERIES["op5_substring_lsm"](spark, sf)) == sorted(brute.dedup_words(doc_rows))


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 500])
def test_odd_substrings(clashing, odd_rows, chunk_bytes):
    out = substring.substring_dedup(clashing, chunk_bytes=chunk_bytes).select("rest.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    assert cut(out) == sorted(brute.dedup_words([r[:2] for r in odd_rows]))


def test_no_substrings(no_docs):
    assert substring.substring_dedup(no_docs).collect() == []


def test_null_and_repeated_ids_are_not_earlier(spark):
    rows = [(None, "a b c d e f g h i j k l m n"), (None, "a b c d e f g h i j k l m n"), (3, "x a b c d e f g h i j k l m"), (3, "x a b c d e f g h i j k l m")]
    out = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("rest.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    key = lambda r: (str(r[0]), r[3])
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(brute.dedup_words(rows), key=key)


def test_index_over_batches(spark, odd_rows):
    """Batches of rising ids against runs of earlier ones give what one pass over everything gives; runs are compacted."""
    index = substring.WindowIndex(spark, bits=3, fanout=2)
    got = []
    for a in range(0, len(odd_rows), 3):
        batch = spark.createDataFrame([r[:2] for r in odd_rows[a : a + 3]], "doc_id long, text string")
        out = index.add(batch, substring.ranges(batch, 2))
        got += cut(out.select("rest.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")))
    assert sorted(got) == sorted(brute.dedup_words([r[:2] for r in odd_rows]))
    assert len(index.runs) <= 3 and index.compactions >= 2


def exchanges(df):
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning(bucket")


def test_five_batches_of_a_table(spark, doc_rows):
    """A whole table is five batches: four leave runs that are compacted, and no batch moves a row of the index."""
    docs = spark.createDataFrame(doc_rows, "doc_id long, text string").repartition(3)
    index = substring.WindowIndex(spark, bits=4)
    out = substring.substring_dedup(docs, chunk_bytes=20_000, index=index)
    assert index.compactions == 1 and [k for k, _ in index.runs] == [1]
    assert cut(out.select("rest.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))) == sorted(brute.dedup_words(doc_rows))
    batch = docs.where("doc_id > 10")
    for runs in (0, 1, 3):
        index = substring.WindowIndex(spark, bits=4)
        for k in range(runs):
            index.add(docs.where(f"doc_id = {k}"), substring.ranges(docs.where(f"doc_id = {k}"), 1))
        assert len(index.runs) == runs
        assert exchanges(index.add(batch, substring.ranges(batch, 2), append=False)) == 1


def test_hot_ids_are_several_chunks(spark):
    """Rows without an id and rows of one id are dealt over chunks, and don't count as earlier than each other."""
    text = [" ".join(f"w{k % 5} x{k % 7} y{j}" for j in range(6)) for k in range(300)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t) for k, t in enumerate(text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = substring.ranges(docs, 12)
    assert 7 in own.bounds and 8 in own.bounds and own.parts[own.bounds.index(7) + 1] >= 3 and own.parts[-1] >= 3
    index = substring.WindowIndex(spark, bits=2)
    out = index.add(docs, own).select("rest.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(brute.dedup_words(rows), key=key)


def test_second_hash_is_independent():
    """Words built to collide modulo 2**64 under any odd factor differ modulo the prime."""
    from spanlens.llm.words import hash_spans, prime_spans

    a, b = "p", "q"
    for _ in range(11):
        a, b = a + b, b + a
    raw = np.frombuffer((a + " " + b).encode(), np.uint8)
    starts, ends = np.array([0, len(a) + 1]), np.array([len(a), 2 * len(a) + 1])
    assert len(set(hash_spans(raw, starts, ends).tolist())) == 1 and len(set(prime_spans(raw, starts, ends).tolist())) == 2


def test_repeats_are_cut_out(odd_docs, odd_rows):
    out = substring.remove_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 6 not in got and got[1] == odd_rows[0][1] and got[3] is None and got[4] == ""
    assert got[7] == odd_rows[6][1]
