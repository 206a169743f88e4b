"""From paired texts to records: overlap, costs, reasons, readers, writers, command lines and streams."""

from __future__ import annotations

import gzip
import json
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlens import __main__ as cli
from spanlens.functions.scorer import BigramScorer, TransformerScorer, token_table
from spanlens.operators import lexsub, overlap
from spanlens.plans import pairs
from spanlens.sources import readers, writers
from spanlens.streaming import spans as streaming


class Plain:
    """Costs from a plain bigram model over the same tokens."""

    def __init__(self, corpus: list[str]):
        self.pair, self.context, kinds = Counter(), Counter(), set()
        for t in corpus:
            w = self.split(t)
            kinds |= set(w)
            self.pair.update(zip(w, w[1:], strict=False))
            self.context.update(w[:-1])
        self.v = len(kinds)

    @staticmethod
    def split(text):
        return re.findall("[A-Za-z]+|[0-9]|[ \t\n\r\f]+|[^A-Za-z0-9 \t\n\r\f]+", text)

    def score(self, text):
        out, at, prev = [], 0, None
        for t in self.split(text):
            cost = None if prev is None else -math.log((self.pair[prev, t] + 0.5) / (self.context[prev] + 0.5 * self.v))
            out.append((at, at + len(t), t, cost))
            at, prev = at + len(t), t
        return out


CORPUS = ["Problem: 12 and 7 birds", "the big cat sat", "a = b + 1\n", "the large cat", "é 😀 12"]


@pytest.fixture(scope="module")
def scorer(spark):
    return BigramScorer(spark.createDataFrame([(t,) for t in CORPUS], "text string"))


def test_token_table(spark, scorer):
    texts = [*CORPUS, "", None, "unseen words 99", "x"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "text_id string, text string")
    got = {}
    for r in scorer.score(df).collect():
        got.setdefault(r["text_id"], []).append((r["pos"], r["char_start"], r["char_end"], r["token"], r["nll"]))
    plain = Plain(CORPUS)
    for i, t in enumerate(texts):
        want = plain.score(t or "")
        own = sorted(got.get(str(i), []))
        assert [x[1:4] for x in own] == [x[:3] for x in want]
        assert [x[4] for x in own] == [None if x[3] is None else pytest.approx(x[3]) for x in want]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 12)), max_size=25), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 12)), max_size=12), st.booleans())
def test_overlap_is_the_plain_one(spark, tokens, spans, empty):
    a = spark.createDataFrame([("t", i, s, s + n) for i, (s, n) in enumerate(tokens)], "k string, pos int, char_start int, char_end int")
    b = spark.createDataFrame([("t", i, s, s + n) for i, (s, n) in enumerate(spans)], "k string, span int, span_start int, span_end int")
    got = sorted((r["pos"], r["span"]) for r in overlap.overlap_join(a, b, ["k"], empty, width=5).collect())
    want = [(i, j) for i, (s, n) in enumerate(tokens) for j, (x, m) in enumerate(spans) if s < x + m and x < s + n and m and (n or empty)]
    assert got == sorted(want)


def test_overlap_of_known_tokens(spark):
    a = spark.createDataFrame([("t", i, s, e, n) for i, (s, e, n) in enumerate([(0, 3, None), (3, 3, 9.0), (3, 6, 2.0), (6, 9, 4.0)])], "k string, pos int, char_start int, char_end int, nll double").withColumn("token", F.lit("x"))
    b = spark.createDataFrame([("t", 0, 4, 7), ("t", 1, 3, 3), ("t", 2, 0, 2)], "k string, span int, span_start int, span_end int")
    got = {r["span"]: (r["sum_nll"], r["mean_nll"], r["num_tokens"], r["tokens"]) for r in overlap.span_costs(overlap.overlap_join(a, b, ["k"]), ["span"], True).collect()}
    assert got == {0: (6.0, 3.0, 2, ["x", "x"]), 2: (None, None, 0, [])}


def number_rows(spark):
    rows = [
        (0, 0, "t", "Level 1", "12 and 7 birds", "12 and 8 birds", "a", "b"), (1, 1, None, "Level 2 ", "7 birds", "7 birds", "a", "b"), (2, 2, "u", "Level 3", "1 2 3", "4 2", None, None),
        (3, 3, "u", "Level 1", "none", "9", None, None), (4, 4, "u", None, None, "9", None, None),
    ]
    return spark.createDataFrame(rows, "row_id long, idx long, type string, level string, original_problem string, problem string, original_answer string, answer string")


def test_number_records(spark, scorer):
    got = {(r["idx"], r["num_index"]): r for r in pairs.number_report(number_rows(spark), scorer).collect()}
    assert set(got) == {(0, 1), (2, 0)}
    r, plain = got[0, 1], Plain(CORPUS)
    assert (r["orig_num"], r["pert_num"], r["count_mismatch"], r["orig_num_count"], len(r)) == ("7", "8", False, 2, 21)

    def cost(text, number):
        return next(c for s, _, t, c in plain.score(text) if t == number)

    assert r["delta_sum_nll"] == pytest.approx(cost("Problem: 12 and 8 birds", "8") - cost("Problem: 12 and 7 birds", "7"))
    assert got[2, 0]["count_mismatch"] and got[2, 0]["pert_num_count"] == 2


@pytest.mark.parametrize(("levels", "n"), [("Level 1,Level 2", 3), ("ALL", 5), ("", 0), (None, 5), ("Level 9", 0)])
def test_levels(spark, levels, n):
    assert pairs.level_filter(number_rows(spark), levels).count() == n


def test_scorer_table_and_direct_costs_agree(spark, scorer):
    class OnlyScore:
        score = staticmethod(scorer.score)

    a, b = (sorted(pairs.number_records(number_rows(spark), s).collect()) for s in (scorer, OnlyScore()))
    assert len(a) == len(b) == 2
    for x, y in zip(a, b, strict=True):
        assert x["delta_sum_nll"] == pytest.approx(y["delta_sum_nll"])


CODE = [
    {"name": "ok", "original_buggy_program": "a = b + 1\n", "counterfactual_buggy_program": "a = b - 1\n", "buggy_span": "+", "counterfactual_span": "-", "solution": "s"},
    {"name": "no program", "original_buggy_program": "", "counterfactual_buggy_program": "x", "buggy_span": "+", "counterfactual_span": "-"},
    {"name": "no span", "original_buggy_program": "a", "counterfactual_buggy_program": "x", "buggy_span": None, "original_span": "a", "counterfactual_span": "-"},
    {"name": "lost", "original_buggy_program": "a a", "counterfactual_buggy_program": "x", "buggy_span": "a", "counterfactual_span": "x"},
    {"name": "first", "original_buggy_program": "a", "counterfactual_buggy_program": "x", "original_span": "a", "counterfactual_span": "x"},
    {"name": "longer", "original_buggy_program": "a = b + 1\n", "counterfactual_buggy_program": "a = c d 1\n", "buggy_span": "b +", "counterfactual_span": "c d 1"},
]


def code_input(tmp_path):
    path = tmp_path / "code.jsonl"
    path.write_text("\n".join(json.dumps(r) + "\n" for r in CODE))
    return str(path)


def test_code(spark, scorer, tmp_path):
    rows = readers.with_ordinal(readers.read_code_pairs(spark, code_input(tmp_path)), "row_id")
    scores = pairs.code_scores(rows, scorer)
    got = {r["name"]: r for r in scores.collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "ok": None, "no program": "missing original_buggy_program or counterfactual_buggy_program", "no span": "missing buggy_span/original_span or counterfactual_span",
        "lost": "could_not_locate_span", "first": "empty_or_unscorable_span", "longer": None,
    }
    plain = Plain(CORPUS)
    assert got["ok"]["delta_sum_nll"] == pytest.approx(plain.score("a = b - 1")[6][3] - plain.score("a = b + 1")[6][3])
    assert got["ok"]["orig_tokens"] == ["+"] and got["longer"]["token_count_mismatch"]
    assert len(pairs.code_records(scores).columns) == 29
    strict = {r["name"]: r["reason"] for r in pairs.code_scores(rows, scorer, skip_token_count_mismatch=True).collect()}
    assert strict["longer"] == "token_count_mismatch" and strict["ok"] is None
    skipped = {r["name"]: r for r in pairs.code_skipped(scores).collect()}
    assert len(skipped) == 4 and skipped["first"]["orig_score"]["num_tokens"] == 0 and skipped["lost"]["orig_span"] == "a"


WORDS = [
    (0, "the big cat sat", "big", "large", None, None, None), (1, "x", " ", "large", None, None, None), (2, "big and big", "big", "large", None, None, None), (3, "nothing", "big", "large", None, None, None),
    (4, None, "big", "Large", "the ", " cat", None), (5, "", "other", "large", None, None, "the **Big** cat"), (6, "a big cat", "big", "BIG", None, None, None), (7, "a big cat", "big", "two words", None, None, None),
    (8, "big cat", "big", "large", None, None, None), (9, "xbig cat", "big", "large", None, None, None), (10, "the big cat", "big", None, None, None, None),
]


def word_rows(spark):
    return spark.createDataFrame(WORDS, "row_idx long, clean_sentence string, target_clean string, substitute string, prefix string, suffix string, Sentence string")


def test_words(spark, scorer):
    got = {r["row_idx"]: r for r in pairs.word_scores(word_rows(spark), scorer, "d").collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        0: None, 1: "missing_target_or_substitute", 2: "target_repeated", 3: "target_not_found", 4: None, 5: None, 6: "same_as_target", 7: "sub_not_single_word",
        8: "orig_no_context_for_first_token", 9: "orig_token_crosses_left_nonspace", 10: "missing_target_or_substitute",
    }
    plain = Plain(CORPUS)
    want = plain.score("the large")[2][3] - plain.score("the big")[2][3]
    assert got[0]["score"] == pytest.approx(want) and got[0]["changed_sentence"] == "the large cat sat"
    assert got[5]["substitute"] == "Large" and got[5]["sentence"] == "the Big cat"
    assert got[0]["score"] == pytest.approx(got[0]["sub_nll"] - got[0]["orig_nll"])
    assert len(pairs.word_records(pairs.word_scores(word_rows(spark), scorer)).columns) == 19
    few = pairs.word_scores(word_rows(spark), scorer, max_examples=2)
    assert sorted(r["row_idx"] for r in few.collect()) == [0, 1, 2, 3, 4]
    kept = pairs.word_scores(word_rows(spark), scorer, max_tokens=2).where("reason is null").count()
    assert kept == 0


def test_contexts(spark, scorer):
    df = spark.createDataFrame([(0, "the big cat", "the large cat"), (1, "", None), (2, "x", "the cat")], "row_idx long, sentence string, changed_sentence string")
    got = {r["row_idx"]: r for r in pairs.context_scores(df, scorer).collect()}
    plain = Plain(CORPUS)
    mean = lambda t: sum(x[3] for x in plain.score(t)[1:]) / len(plain.score(t)[1:])
    assert got[0]["context_score"] == pytest.approx(mean("the large cat") - mean("the big cat"))
    assert (got[1]["orig_context_mean_nll"], got[1]["sub_context_num_tokens"]) == (0.0, 0)
    assert got[2]["orig_context_num_tokens"] == 0 and got[2]["orig_context_sum_nll"] == 0.0


def test_marked_filter(spark):
    rows = [("A **big (x)** b", "big", "['huge']"), ("A **big** b", "no", "['Huge (B2)', 'huge', 'big', 'two words', 'vast']"), ("plain", " big ", "vast, Big"), ("A **big** b", "x", None)]
    df = spark.createDataFrame(rows, "Sentence string, `target word` string, acc_subs string")
    long = lexsub.filter_marked(df, explode=True).orderBy("source_row_idx", "substitute").collect()
    assert [(r["source_row_idx"], r["clean_sentence"], r["target_clean"], r["substitute"]) for r in long] == [(1, "A big b", "big", "Huge"), (1, "A big b", "big", "vast"), (2, "plain", "big", "vast")]
    wide = {r["source_row_idx"]: r for r in lexsub.filter_marked(df).collect()}
    assert wide[1]["acc_subs_oneword"] == ["Huge", "vast"] and wide[1]["first_substitute"] == "Huge" and wide[1]["num_oneword_subs"] == 2
    with pytest.raises(ValueError, match="acc_subs"):
        lexsub.filter_marked(df.drop("acc_subs"))
    with pytest.raises(ValueError, match="target"):
        lexsub.filter_marked(df.drop("target word"))


SWORDS = {
    "contexts": {"c1": {"context": "the big cat"}, "c2": {"context": "big party, big"}},
    "targets": {
        "t1": {"context_id": "c1", "target": "big", "offset": 4, "pos": "ADJ"}, "t2": {"context_id": "c2", "target": "big", "offset": 0}, "t3": {"context_id": "c1", "target": "big", "offset": 3},
        "t4": {"context_id": "c1", "target": "big cat", "offset": 4}, "t5": {"context_id": "c1", "target": "cat", "offset": 8},
    },
    "substitutes": {
        "s1": {"target_id": "t1", "substitute": "large"}, "s2": {"target_id": "t1", "substitute": "Big"}, "s3": {"target_id": "t1", "substitute": "very large"}, "s4": {"target_id": "t1", "substitute": "tiny"},
        "s5": {"target_id": "t2", "substitute": "large"}, "s6": {"target_id": "t3", "substitute": "large"}, "s7": {"target_id": "t1", "substitute": "vast"},
    },
    "substitute_labels": {"s1": ["TRUE", "FALSE"], "s2": ["TRUE"], "s4": ["FALSE"], "s5": ["TRUE"], "s6": ["TRUE"]},
}


def swords_path(tmp_path):
    path = tmp_path / "swords.json.gz"
    path.write_bytes(gzip.compress(json.dumps(SWORDS, indent=1).encode()))
    return str(path)


def test_substitution_document(spark, tmp_path):
    judged = lexsub.judge_substitutions(lexsub.unpack_substitutions(readers.read_substitutions(spark, swords_path(tmp_path))))
    kept = judged.where("reason is null").collect()
    assert [(r["source_substitute_id"], r["prefix"], r["suffix"], r["label_score"], r["num_labels"], r["pos"]) for r in kept] == [("s1", "the ", " cat", 0.5, 2, "ADJ")]
    assert {r["reason"]: r["n"] for r in lexsub.substitution_reasons(judged).collect()} == {"bad_offset": 1, "target_not_one_word": 1, "target_repeated": 1, "same_as_target": 1, "sub_not_one_word": 1, "low_label_score": 2}
    loose = lexsub.judge_substitutions(lexsub.unpack_substitutions(readers.read_substitutions(spark, swords_path(tmp_path))), 0.5, True)
    assert loose.where("reason is null").count() == 2


def test_sample(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    a, b = (sorted(r["k"] for r in lexsub.exact_sample(df.repartition(n), 7, "k").collect()) for n in (1, 5))
    assert a == b and len(set(a)) == 7
    assert a != sorted(r["k"] for r in lexsub.exact_sample(df, 7, "k", seed=1).collect())
    with pytest.raises(ValueError, match="fewer"):
        lexsub.exact_sample(df, 51, "k")


def test_readers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n"x ""q""\ny",NA\nnull,2\n')
    rows = readers.read_csv(spark, str(path), "a string, b string").collect()
    assert [tuple(r) for r in rows] == [('x "q"\ny', None), (None, "2")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception, match="[Mm]alformed"):
        readers.read_json_lines(spark, str(bad), "a int").collect()
    doc = tmp_path / "d.json"
    doc.write_text(json.dumps([{"idx": 1, "problem": "p"}, {"idx": 2}], indent=2))
    assert [r["idx"] for r in readers.read_dataset(spark, str(doc)).collect()] == [1, 2]
    df = readers.with_ordinal(spark.range(0, 100, 1, 7).withColumnRenamed("id", "v"), "i")
    assert all(r["i"] == r["v"] for r in df.collect())


def test_writers(spark, tmp_path):
    assert writers.derived_paths("x/a.jsonl") == {"records": "x/a.jsonl", "summary": "x/a.summary.json", "skipped": "x/a.skipped.jsonl"}
    assert len(set(writers.derived_paths("plain").values())) == 3
    df = spark.createDataFrame([(1, None, ["é", "b"])], "a int, b string, c array<string>")
    writers.write_json_lines(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    assert json.loads(text) == {"a": 1, "b": None, "c": ["é", "b"]} and "é" in text
    writers.write_json_lines(df.limit(0), str(tmp_path / "none"))
    assert (tmp_path / "none" / "_SUCCESS").exists()
    writers.write_csv(df, str(tmp_path / "c"))
    assert '"[""é"",""b""]"' in "".join(p.read_text() for p in (tmp_path / "c").glob("part*"))
    writers.write_summary(spark, str(tmp_path / "new" / "s.json"), {"n": 1})
    assert json.loads((tmp_path / "new" / "s.json").read_text()) == {"n": 1}


def test_command_lines(spark, tmp_path, capsys):
    corpus = tmp_path / "corpus.txt"
    corpus.write_text("\n".join(t.strip() for t in CORPUS))
    nums = tmp_path / "n.jsonl"
    nums.write_text("\n".join(json.dumps(r.asDict()) for r in number_rows(spark).drop("row_id").collect()))
    m = cli.main(["math", "--dataset", str(nums), "--bigram", str(corpus), "--levels", "all", "--out_jsonl", str(tmp_path / "o/m.jsonl")])
    assert m["num_records"] == 2 == m["delta_sum_nll"]["n"] and m["num_count_mismatch_records"] == 1
    assert json.loads((tmp_path / "o/m.summary.json").read_text())["levels"] == "all"
    assert sum(x["n"] for x in m["by_type"].values()) == sum(x["n"] for x in m["by_level"].values()) == 2
    c = cli.main(["code", "--input_jsonl", code_input(tmp_path), "--bigram", str(corpus), "--out_jsonl", str(tmp_path / "o/c.jsonl")])
    assert (c["num_records"], c["num_skipped"], c["num_input"]) == (2, 4, 6)
    data = tmp_path / "w"
    writers.write_csv(word_rows(spark).coalesce(1), str(data))
    w = cli.main(["word", "--data", str(data), "--bigram", str(corpus), "--out", str(tmp_path / "o/w.csv")])
    assert w["kept"] + sum(w["skip"].values()) == w["num_input_rows"] == len(WORDS)
    x = cli.main(["context", "--input", str(tmp_path / "o/w.csv"), "--bigram", str(corpus), "--out", str(tmp_path / "o/x.csv")])
    assert x["n"] == w["n"] == 3
    d = cli.main(["word", "--mode", "compare", "--old_csv", str(tmp_path / "o/w.csv"), "--new_csv", str(tmp_path / "o/w.csv"), "--compare_out", str(tmp_path / "o/cmp.json")])
    assert d["auc_old_higher_than_new"] == 0.5 and d["difference_mean_old_minus_new"] == 0
    e = cli.main(["context", "--mode", "compare", "--old_csv", str(tmp_path / "o/x.csv"), "--new_csv", str(tmp_path / "o/x.csv")])
    assert e["cohens_d_old_minus_new"] in (0, None)
    s = cli.main(["swords", "--input", swords_path(tmp_path), "--output", str(tmp_path / "o/s.csv"), "--n", "1"])
    assert s["kept"] == 1
    p = tmp_path / "p.csv"
    p.write_text("Sentence,target,acc_subs\nA **big** b,big,\"['vast', 'huge']\"\n")
    assert cli.main(["prolex", "--input", str(p), "--output", str(tmp_path / "o/p.csv"), "--explode"])["rows"] == 2
    try:
        cli.main(["plot", "--input", str(tmp_path / "o/w.csv"), "--out", str(tmp_path / "h.png")])
    except RuntimeError as error:
        assert "matplotlib" in str(error)


def test_stream(spark, scorer, tmp_path):
    source, rows = str(tmp_path / "in"), number_rows(spark)
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = streaming.score_stream(stream, scorer, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/batch=*"))
    want = pairs.number_records(rows, scorer)
    own = lambda df: sorted((r["row_id"], r["num_index"], round(r["delta_sum_nll"], 9)) for r in df.collect())
    assert own(got) == own(want)
    found = streaming.changed_numbers(stream).writeStream.format("memory").queryName("changed").trigger(availableNow=True).start()
    found.awaitTermination(120)
    assert spark.table("changed").count() == pairs.number_pairs(rows).count()
    values = spark.readStream.schema("row_id long, idx long, type string, level string").parquet(source)
    summary = streaming.running_stats(values.withColumn("x", F.col("idx").cast("double")), "x", ["type"]).writeStream.format("memory").queryName("summary").outputMode("complete").trigger(availableNow=True).start()
    summary.awaitTermination(120)
    assert {r["type"]: r["n"] for r in spark.table("summary").collect()} == {"t": 1, None: 1, "u": 3}


def test_model_scorer_needs_its_libraries(spark):
    texts = spark.createDataFrame([("a", "b")], "text_id string, text string")
    df = TransformerScorer("no/model").score(texts)
    assert df.columns == ["text_id", "pos", "char_start", "char_end", "token_id", "token", "nll"]
    try:
        import torch  # noqa: F401
        import transformers  # noqa: F401
    except ImportError:
        with pytest.raises(Exception, match="No module named"):
            df.collect()


def test_tokens_tile_the_text(spark):
    texts = spark.createDataFrame([("a", "x 1\n é😀--"), ("b", ""), ("c", None)], "text_id string, text string")
    rows = token_table(texts).orderBy("text_id", "pos").collect()
    assert "".join(r["token"] for r in rows) == "x 1\n é😀--" and {r["text_id"] for r in rows} == {"a"}
