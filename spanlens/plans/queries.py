"""The registered queries: every operator applied to a whole supplied table.

The tables have no paired perturbations, so pairs are derived: a perturbed text has each digit replaced by the next one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.functions import text as X
from spanlens.functions.scorer import BigramScorer
from spanlens.operators import lexsub, overlap, stats
from spanlens.operators.locate import locate_span
from spanlens.plans import pairs
from spanlens.sources import readers, writers
from spanlens.sources.scratch import scratch_path, staged

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def shifted(c: str):
    return F.translate(c, "0123456789", "1234567890")


def number_rows(spark, sf_dir) -> DataFrame:
    """Documents with a digit as pairs of problems."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").where(F.col("text").rlike("[0-9]"))
    return docs.select(
        F.col("doc_id").alias("row_id"), F.col("doc_id").alias("idx"), F.col("lang").alias("type"), F.col("source").alias("level"),
        F.col("text").alias("original_problem"), shifted("text").alias("problem"), F.lit(None).cast("string").alias("original_answer"), F.lit(None).cast("string").alias("answer"),
    )


def talk(spark, sf_dir) -> DataFrame:
    """Turns of conversations as texts."""
    return table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("text_id"), "text")


def document_scorer(spark, sf_dir) -> BigramScorer:
    return BigramScorer(table(spark, sf_dir, "documents").select("text"))


@query
def extract_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("of"), F.col("doc_id").alias("id"), "text")
    names = table(spark, sf_dir, "customer").select(F.lit("customer").alias("of"), F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    found = docs.unionByName(names).where(F.col("text").rlike("[0-9]")).select("of", "id", F.posexplode(X.numbers(F.col("text"))).alias("num_index", "n"))
    return found.select("of", "id", "num_index", F.col("n.start").alias("start"), F.col("n.end").alias("end"), F.col("n.value").alias("value"))


@query
def number_pairs(spark, sf_dir):
    return pairs.number_pairs(number_rows(spark, sf_dir))


@query
def number_pair_counts(spark, sf_dir):
    """Pairs whose counts differ: the other text has lost its ones."""
    rows = number_rows(spark, sf_dir).withColumn("problem", F.replace("original_problem", F.lit("1"), F.lit("")))
    own = pairs.number_pairs(rows, changed_only=False)
    counted = own.groupBy("row_id").agg(F.first("orig_num_count").alias("orig_num_count"), F.first("pert_num_count").alias("pert_num_count"), F.count("*").alias("pairs"), F.count_if("changed").alias("changed"))
    return counted.withColumn("count_mismatch", F.col("orig_num_count") != F.col("pert_num_count"))


@query
def bigram_nll(spark, sf_dir):
    turns = talk(spark, sf_dir)
    return rounded(BigramScorer(turns).score(turns).drop("token_id"))


@query
def number_span_scores(spark, sf_dir):
    return rounded(pairs.number_records(number_rows(spark, sf_dir), document_scorer(spark, sf_dir)))


@query
def number_delta_stats(spark, sf_dir):
    rows = number_rows(spark, sf_dir)
    records = pairs.number_records(rows, document_scorer(spark, sf_dir)).join(rows.select("row_id", "type", "level"), "row_id")
    records = staged(records.select("delta_sum_nll", "type", "level"), "records")  # read once for each step of the medians
    return rounded(stats.by_groups(records, "delta_sum_nll", ["type", "level"]), 4)


@query
def number_report(spark, sf_dir):
    return rounded(pairs.number_report(number_rows(spark, sf_dir), document_scorer(spark, sf_dir)).drop("original_answer", "answer"))


@query
def context_mean_nll(spark, sf_dir):
    turns = talk(spark, sf_dir)
    rows = turns.select(F.col("text_id").alias("row_idx"), F.col("text").alias("sentence"), F.replace("text", F.lit("e "), F.lit("a ")).alias("changed_sentence"))
    bench = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("row_idx"), F.col("text").alias("sentence"), F.lower("text").alias("changed_sentence"))
    return rounded(pairs.context_scores(rows.unionByName(bench), BigramScorer(turns)).drop("sentence", "changed_sentence"))


@query
def stats_math(spark, sf_dir):
    return rounded(stats.by_groups(table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_extendedprice") * (F.col("l_discount") - 0.05)), "x", ["l_returnflag", "l_linestatus"]), 2)


@query
def stats_code(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * (F.col("l_tax") - 0.04)).alias("x"))
    return rounded(stats.grouped(rows, ["l_returnflag"], stats.stats_code("x"), stats.medians_of(F.col("x"))))


def event_scores(spark, sf_dir) -> DataFrame:
    """Event values as pairs of log-probabilities: the second one is that of the hour's part of the value."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", (-F.col("value")).alias("orig_logp"), (-(F.col("value") * (F.col("user_id") % 7) / 3)).alias("sub_logp"))
    return events.withColumn("score", F.col("orig_logp") - F.col("sub_logp"))


@query
def stats_word(spark, sf_dir):
    rows = event_scores(spark, sf_dir)
    return rounded(stats.grouped(rows, ["event_type"], stats.stats_word(F.col("score"), F.col("orig_logp"), F.col("sub_logp")), stats.medians_of(F.col("score"))))


@query
def stats_context(spark, sf_dir):
    rows = event_scores(spark, sf_dir)
    return rounded(stats.grouped(rows, ["event_type"], stats.stats_context(F.col("score"), -F.col("orig_logp"), -F.col("sub_logp")), stats.medians_of(F.col("score"))))


@query
def median_any_size(spark, sf_dir):
    return rounded(stats.exact_median(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]))


def two_samples(spark, sf_dir):
    """Quantities of one return flag against those of all others."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "A").cast("int").alias("label"))


@query
def tie_ranks(spark, sf_dir):
    return stats.tie_ranks(table(spark, sf_dir, "lineitem"), "l_quantity")


@query
def auc_old_new(spark, sf_dir):
    return rounded(stats.auc(two_samples(spark, sf_dir), "score", "label"), 9)


@query
def cohens_d(spark, sf_dir):
    return rounded(stats.cohens_d(two_samples(spark, sf_dir), "score", "label"), 9)


@query
def compare_summary(spark, sf_dir):
    rows = event_scores(spark, sf_dir)
    out = stats.compare(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "score", stats.stats_word(F.col("score"), F.col("orig_logp"), F.col("sub_logp")), stats.medians_of(F.col("score")))
    flat = out.select(
        F.col("old.n").alias("old_n"), F.col("new.n").alias("new_n"), F.col("old.mean").alias("old_mean"), F.col("new.mean").alias("new_mean"), F.col("old.median").alias("old_median"),
        F.col("old.positive_half_mean").alias("old_positive_half_mean"), "difference_mean_old_minus_new", "auc_old_higher_than_new", "cohens_d_old_minus_new",
    )
    return rounded(flat)


@query
def histogram(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "orders"), ["o_totalprice"]), 4)


@query
def histogram_density(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("value").alias("orig_nll"), (F.col("value") * 2 + 1).alias("sub_nll"))
    return rounded(stats.histogram(rows, ["orig_nll", "sub_nll"], 20, density=True), 6)


@query
def axis_means(spark, sf_dir):
    rows = event_scores(spark, sf_dir)
    return rounded(rows.agg(F.avg(-F.col("orig_logp")).alias("orig_mean"), F.avg(-F.col("sub_logp")).alias("sub_mean"), (F.avg(-F.col("sub_logp")) - F.avg(-F.col("orig_logp"))).alias("sub_minus_orig")))


@query
def locate_spans(spark, sf_dir):
    """A tag of each page, looked for with five kinds of hints."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("t"))
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    first = F.instr("t", "<p>") - 1
    line2 = F.coalesce(F.get(F.split("t", "\n"), F.lit(1)), F.lit(""))
    case = lambda name, span, line, start, index: F.struct(F.lit(name).alias("hint"), F.lit(span).alias("span"), line.alias("line"), start.alias("span_start"), index.alias("line_index"))
    cases = F.array(
        case("start", "<p>", text, first, none),
        case("index", "<", text, F.lit(40), F.lit(1)),
        case("index_only", ">", text, none, F.lit(2)),
        case("line", "a", line2, none, none),
        case("unique", "</html>", text, none, none),
        case("repeated", "<", text, none, F.lit(-1)),
    )
    rows = pages.select("page_id", "t", F.explode(cases).alias("c")).select("page_id", "t", "c.*")
    return rows.withColumn("l", locate_span(F.col("t"), F.col("span"), F.col("line"), F.col("span_start"), F.col("line_index"))).select("page_id", "hint", "l.start", "l.end", "l.mode")


@query
def occurrences(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("t"))
    return pages.select("page_id", F.posexplode(X.occurrences(F.col("t"), F.lit("<p"))).alias("i", "start"))


@query
def line_offsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.lines(F.col("text")).alias("l"))
    sizes = F.transform("l", lambda x: F.char_length(x))
    return docs.select("doc_id", F.posexplode(F.zip_with(X.running_sum(sizes), sizes, lambda a, n: F.struct(a.alias("start"), n.alias("size")))).alias("line_index", "x")).select("doc_id", "line_index", "x.*")


def part_sentences(spark, sf_dir) -> DataFrame:
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", word.alias("word"), F.concat(F.lit("The **"), word, F.lit("** of "), "p_name", F.lit(" in **"), "p_type", F.lit("**.")).alias("marked"))


@query
def marked_target(spark, sf_dir):
    return part_sentences(spark, sf_dir).select("p_partkey", X.marked_target(F.col("marked")).alias("m")).select("p_partkey", "m.*")


@query
def without_marks(spark, sf_dir):
    return part_sentences(spark, sf_dir).select("p_partkey", X.without_marks(F.col("marked")).alias("sentence"))


@query
def find_target(spark, sf_dir):
    rows = part_sentences(spark, sf_dir)
    sentence = F.concat("p_name", F.lit(" or "), F.lower("p_type"))
    targets = F.array(F.col("word"), F.upper(F.split_part("p_type", F.lit(" "), F.lit(-1))), F.lit("e"), F.lit("zzz"))
    own = rows.select("p_partkey", sentence.alias("s"), F.posexplode(targets).alias("kind", "target"))
    return own.select("p_partkey", "kind", X.find_target(F.col("s"), F.col("target")).alias("f")).select("p_partkey", "kind", "f.problem", "f.prefix", "f.target", "f.suffix")


@query
def match_case(spark, sf_dir):
    rows = part_sentences(spark, sf_dir)
    references = F.array(F.upper("word"), F.initcap("word"), F.lower("word"), F.lit("I"), F.lit("a1"))
    return rows.select("p_partkey", F.posexplode(references).alias("kind", "reference"), F.lower("p_type").alias("w")).select("p_partkey", "kind", X.match_case(F.col("w"), F.col("reference")).alias("word"))


@query
def one_word(spark, sf_dir):
    rows = part_sentences(spark, sf_dir)
    words = F.array(F.concat(F.lit(" "), "word", F.lit("\t")), F.col("p_name"), F.col("p_brand"), F.lit(""))
    return rows.select("p_partkey", F.posexplode(words).alias("kind", "w")).select("p_partkey", "kind", X.one_word(F.col("w")).alias("ok"))


@query
def distinct_words(spark, sf_dir):
    words = F.concat(F.split("p_name", " "), F.transform(F.split("p_name", " "), lambda x: F.upper(x)), F.split("p_type", " "), F.split("p_name", " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(X.distinct_words(words)).alias("words"))


@query
def parse_word_lists(spark, sf_dir):
    word = F.split("p_name", " ")
    listed = F.array(
        F.concat(F.lit("['"), F.array_join(word, " (B2)', '"), F.lit("']")), F.array_join(word, ", "), F.concat(F.lit("["), F.array_join(word, ", "), F.lit("]")), F.lit(""), F.lit(None).cast("string")
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(listed).alias("kind", "s"))
    return rows.select("p_partkey", "kind", F.to_json(X.parse_words(F.col("s"))).alias("words"))


@query
def label_score(spark, sf_dir):
    labels = F.array(F.when(F.col("quality") == 1, "TRUE").otherwise("FALSE"), F.when(F.col("toxic") == 1, "true_implicit").otherwise("False"), F.lit("TRUE_IMPLICIT"))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(labels).alias("labels"))
    return rows.select("doc_id", F.round(X.label_score(F.col("labels")), 9).alias("score"))


def substitution_file(spark, sf_dir) -> str:
    """One JSON document of id-keyed maps: parts as targets in a context, words of their type and name as substitutes with labels.

    Substitutes of small parts have no labels."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    word = F.split_part("p_name", F.lit(" "), F.lit(-1))
    key = F.col("p_partkey").cast("string")
    offset = (F.instr("p_name", word) - 1 + F.when(F.col("p_size") == 7, 1).otherwise(0)).alias("offset")
    entry = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    yes = lambda n: F.when(F.col("sid") % n == 0, "FALSE").otherwise("TRUE")
    subs = part.select(key.alias("target_id"), "p_size", F.col("p_partkey").alias("p"), F.posexplode(F.concat(F.split(F.lower("p_type"), " "), F.split("p_name", " "))).alias("i", "substitute"))
    subs = subs.withColumn("sid", F.col("p") * 7 + F.col("i"))
    sid = F.col("sid").cast("string")
    one = part.agg(entry(key, F.struct(F.concat("p_name", F.lit(" is "), F.lower("p_type")).alias("context"))).alias("contexts"), entry(key, F.struct(key.alias("context_id"), word.alias("target"), offset, F.lit("NOUN").alias("pos"))).alias("targets"))
    two = subs.agg(entry(sid, F.struct("target_id", "substitute")).alias("substitutes"))
    three = subs.where("p_size > 12").agg(entry(sid, F.array(yes(2), yes(3), F.lit("FALSE"))).alias("substitute_labels"))
    path = scratch_path(spark, "substitutions")
    one.join(two).join(three).write.option("compression", "gzip").json(path)
    return path


def unpacked(spark, sf_dir) -> DataFrame:
    return lexsub.unpack_substitutions(readers.read_substitutions(spark, substitution_file(spark, sf_dir)))


def judged(spark, sf_dir) -> DataFrame:
    out = lexsub.judge_substitutions(unpacked(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("long") for c in ("source_target_id", "source_substitute_id")})


@query
def substitution_document(spark, sf_dir):
    rows = unpacked(spark, sf_dir)
    return rows.select("target_id", "context_id", "context", "target", "offset", "pos", "sid", "substitute", F.array_join("labels", ",").alias("labels"))


@query
def substitution_join(spark, sf_dir):
    return rounded(judged(spark, sf_dir).where("reason is null").drop("reason", "dataset", "pos"))


@query
def reason_counts(spark, sf_dir):
    return lexsub.substitution_reasons(judged(spark, sf_dir))


@query
def repeated_target_filter(spark, sf_dir):
    rows = part_sentences(spark, sf_dir).withColumn("s", F.concat("p_name", F.lit(" "), F.lower("p_type")))
    return rows.select("p_partkey", X.count_separate(F.col("s"), F.substring("word", 1, 2)).alias("n")).where("n = 1")


@query
def filter_marked(spark, sf_dir):
    rows = part_sentences(spark, sf_dir).select(
        "p_partkey", F.col("marked").alias("Sentence"), F.col("word").alias("target word"), F.concat(F.lit("['"), F.array_join(F.split("p_name", " "), "', '"), F.lit("']")).alias("acc_subs")
    )
    out = lexsub.filter_marked(rows, explode=True, ordinal="p_partkey")
    return out.select("p_partkey", "clean_sentence", "target_clean", "substitute")


@query
def exact_n_sample(spark, sf_dir):
    return lexsub.exact_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


@query
def early_stop(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_idx"), F.when(F.col("value") < 20, "low").alias("reason"))
    return lexsub.stop_after(rows, 500)


@query
def prefix_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("level"))
    return pairs.level_filter(rows, "en, de").orderBy("doc_id").limit(50)


def word_rows(spark, sf_dir) -> DataFrame:
    """Three kinds of rows from parts: with prefix and suffix, marked, and to be searched."""
    part = table(spark, sf_dir, "part")
    word, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(-1))
    kind = F.col("p_partkey") % 3
    return part.select(
        F.col("p_partkey").alias("row_idx"), F.when(kind == 0, F.concat(F.lit("a "), "p_name")).otherwise(F.concat("p_name", F.lit("."))).alias("clean_sentence"), word.alias("target_clean"),
        F.initcap(last).alias("substitute"), F.when(kind == 0, F.lit("a ")).alias("prefix"), F.when(kind == 0, F.substring("p_name", F.char_length(word) + 1, F.lit(1000))).alias("suffix"),
        F.when(kind == 1, F.concat(F.lit("so **"), word, F.lit("** is "), "p_name")).alias("Sentence"),
    )


@query
def word_examples(spark, sf_dir):
    return lexsub.build_examples(word_rows(spark, sf_dir)).select("row_idx", "sentence", "prefix", "target", "suffix", "substitute", "reason")


@query
def word_scores(spark, sf_dir):
    scorer = BigramScorer(table(spark, sf_dir, "part").select(F.col("p_name").alias("text")))
    out = pairs.word_scores(word_rows(spark, sf_dir), scorer)
    return rounded(out.select("row_idx", "changed_sentence", "orig_nll", "sub_nll", "score", "orig_num_tokens", "sub_num_tokens", "reason"))


def program_rows(spark, sf_dir) -> DataFrame:
    """Pages as programs: a tag is the span, and the other side has another tag in its place."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    gone = F.col("page_id") % 7
    return pages.select(
        F.col("page_id").alias("row_id"), F.col("page_id").cast("string").alias("name"), F.when(gone != 1, F.col("html")).alias("original_buggy_program"),
        F.replace("html", F.lit("</html>"), F.lit("</main>;")).alias("counterfactual_buggy_program"),
        F.when(gone == 2, F.lit("")).when(gone == 3, F.lit("<nowhere>")).otherwise(F.lit("</html>")).alias("buggy_span"), F.when(gone == 4, F.lit("<")).otherwise(F.lit("</main>;")).alias("counterfactual_span"),
    )


@query
def code_scores(spark, sf_dir):
    scorer = BigramScorer(table(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    out = pairs.code_scores(program_rows(spark, sf_dir), scorer)
    return rounded(out.select(F.col("row_id").alias("page_id"), "orig_span_start", "cf_span_start", "orig_loc_mode", "orig_sum_nll", "cf_sum_nll", "delta_sum_nll", "delta_mean_nll", "orig_num_tokens", "cf_num_tokens", "token_count_mismatch", "reason"))


@query
def json_records_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "records")
    writers.write_json_lines(table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.when(F.col("user_id") % 3 == 0, F.col("props")).alias("props")), path)
    return readers.read_json_lines(spark, path, "event_id bigint, event_type string, value double, props string")


@query
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "table")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('say "'), "p_name", F.lit('",\n'), "p_type").alias("text"), F.when(F.col("p_size") % 2 == 0, F.lit("NA")).otherwise(F.lit("x")).alias("flag"))
    writers.write_csv(rows, path)
    return readers.read_csv(spark, path, "p_partkey bigint, text string, flag string")


@query
def ordinal_rows(spark, sf_dir):
    rows = readers.with_ordinal(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "row_idx")
    return rows.select("row_idx", "n_name")


@query
def span_overlap(spark, sf_dir):
    """Tokens of benchmark texts over fixed windows of twenty characters."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    from spanlens.functions.scorer import token_table

    tokens = token_table(texts).drop("prev")
    spans = texts.select("id", F.explode(F.sequence(F.lit(0), F.char_length("text"), F.lit(50))).alias("span_start")).withColumn("span_end", F.col("span_start") + 20)
    return overlap.overlap_join(tokens, spans, ["id"]).select("id", "span_start", "pos", "char_start", "char_end", "token")


@query
def parse_word_shapes(spark, sf_dir):
    """Written lists of other shapes: tuples with and without parentheses, literals side by side, nested lists, notes."""
    w = [F.coalesce(F.get(F.split("p_name", " "), F.lit(i)), F.lit("x")) for i in (0, 1)]
    join = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    listed = F.array(
        join("'", w[0], "', '", w[1], "'"), join("('", w[0], "','", w[1], "')"), join("['", w[0], "' '", w[1], "']"), join("'", w[0], "'"), join("[['", w[0], "', 1], ['", w[1], "', 2]]"),
        join("[('", w[0], "', 1), ('", w[1], "', 2)]"), join("['", w[0], " (verb)', '', \"", w[1], "\"]"), join("[", w[0], ", '", w[1], "'"), join("['", w[0], "', '", w[1], "' '", w[0], "']"),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(listed).alias("kind", "s"))
    return rows.select("p_partkey", "kind", F.to_json(X.parse_words(F.col("s"))).alias("words"))


def pair_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("type"), F.col("p_brand").alias("level"), F.concat(F.lit("There are "), "p_size", F.lit(" of ”"), "p_name", F.lit("”.")).alias("original_problem"))


@query
def dataset_document(spark, sf_dir):
    """A whole table as one JSON document, read as a data set; fields that it lacks are null."""
    path = f"{scratch_path(spark, 'dataset')}.json"
    pair_rows(spark, sf_dir).agg(F.to_json(F.sort_array(F.collect_list(F.struct("*")))).alias("value")).write.text(path)
    return readers.read_dataset(spark, path)


@query
def dataset_lines(spark, sf_dir):
    """A table as JSON lines, some without a level, read as a data set; required columns are there even where no line has them."""
    path = f"{scratch_path(spark, 'dataset')}.jsonl"
    rows = pair_rows(spark, sf_dir).withColumn("level", F.when(F.col("level") != "Brand#2", F.col("level")))
    rows.write.option("ignoreNullFields", "true").json(path)
    out = readers.read_dataset(spark, path)
    readers.require_columns(out, ["original_problem", "problem", "level"])
    return out


@query
def snapshot_rows(spark, sf_dir):
    """A local snapshot of a hub data set, by name and split."""
    root = scratch_path(spark, "snapshots")
    pair_rows(spark, sf_dir).write.parquet(f"{root}/some/pairs/test")
    return readers.read_snapshot(spark, "some/pairs", "test", root)


@query
def key_fallback(spark, sf_dir):
    """Lines with a span under its first name, under its second, under both, and with a null under the first."""
    path = scratch_path(spark, "lines")
    kind = F.col("p_partkey") % 4
    name = F.struct(F.col("p_partkey").cast("string").alias("name"), F.col("p_name").alias("original_span"))
    both = F.struct(F.col("p_partkey").cast("string").alias("name"), F.when(kind != 3, F.col("p_type")).alias("buggy_span"), F.col("p_name").alias("original_span"))
    only = F.struct(F.col("p_partkey").cast("string").alias("name"), F.col("p_type").alias("buggy_span"))
    as_json = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    table(spark, sf_dir, "part").select(F.when(kind == 0, as_json(name)).when(kind == 1, as_json(only)).otherwise(as_json(both)).alias("value")).write.text(path)
    return readers.read_code_pairs(spark, path).select("name", "span", "buggy_span", "original_span", "line_index")


@query
def finite_values(spark, sf_dir):
    """Sums and counts of what is a finite number, among infinities, values that are no number, and nulls."""
    x = F.col("l_quantity").cast("double")
    odd = F.when(x == 1, float("nan")).when(x == 2, float("inf")).when(x == 3, float("-inf")).when(x == 4, F.lit(None)).otherwise(x)
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", X.finite(odd).alias("x"))
    return rounded(rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("x").alias("n_finite"), F.sum("x").alias("sum"), F.min("x").alias("min"), F.max("x").alias("max")))


@query
def null_contexts(spark, sf_dir):
    """Costs of whole texts some of which are null or empty: such texts cost nothing."""
    turns = talk(spark, sf_dir)
    rows = turns.select("text_id", F.when(F.char_length("text") % 3 == 1, F.lit(None)).when(F.char_length("text") % 3 == 2, F.lit("")).otherwise(F.col("text")).alias("text"))
    return rounded(pairs.context_costs(rows, BigramScorer(turns)))


@query
def filter_marked_lists(spark, sf_dir):
    """The marked sentences with the list of their substitutes, the first one and how many there are."""
    rows = part_sentences(spark, sf_dir).select(
        "p_partkey", F.col("marked").alias("Sentence"), F.col("word").alias("target"), F.concat(F.lit("['"), F.array_join(F.concat(F.split("p_name", " "), F.split(F.lower("p_type"), " ")), "', '"), F.lit("']")).alias("acc_subs")
    )
    out = lexsub.filter_marked(rows, ordinal="p_partkey")
    return out.select("p_partkey", "clean_sentence", "target_clean", F.to_json("acc_subs_oneword").alias("acc_subs_oneword"), "first_substitute", "num_oneword_subs", "source_row_idx")


def odd_programs(spark, sf_dir) -> DataFrame:
    """Program pairs with all optional fields; one in seven begins with its span, where nothing can be scored."""
    rows = program_rows(spark, sf_dir)
    first = F.col("row_id") % 7 == 5
    begin = F.substring("counterfactual_buggy_program", 1, 2)
    return rows.withColumns(
        {
            "buggy_span": F.when(first, begin).otherwise(F.col("buggy_span")), "counterfactual_span": F.when(first, begin).otherwise(F.col("counterfactual_span")), "span_start": F.when(first, 0),
            "variant_id": F.concat(F.lit("v"), "row_id"), "fix_span": F.lit("</html>"), "mutation_type": F.when(F.col("row_id") % 2 == 0, "tag"), "buggy_line": F.lit(None).cast("string"),
        }
    )


def page_scores(spark, sf_dir) -> DataFrame:
    return pairs.code_scores(odd_programs(spark, sf_dir), BigramScorer(table(spark, sf_dir, "pages").select(F.col("html").alias("text"))))


@query
def code_record_rows(spark, sf_dir):
    """Full records of program pairs, with the tokens of both spans."""
    out = pairs.code_records(page_scores(spark, sf_dir))
    return rounded(out.withColumns({"orig_tokens": F.array_join("orig_tokens", " "), "cf_tokens": F.array_join("cf_tokens", " ")}))


@query
def code_skipped_rows(spark, sf_dir):
    """Program pairs that give no record, with the reason and what was known of them."""
    out = pairs.code_skipped(page_scores(spark, sf_dir))
    return out.select("name", "reason", "orig_loc_mode", "cf_loc_mode", "orig_span", "cf_span", F.col("orig_score.num_tokens").alias("orig_scored"), F.col("cf_score.sum_nll").alias("cf_sum_nll"))


@query
def word_record_rows(spark, sf_dir):
    """Full records of substituted words; some rows lack the target or the substitute."""
    rows = word_rows(spark, sf_dir)
    size = F.col("row_idx") % 10
    rows = rows.withColumns({"target_clean": F.when(size == 8, F.lit(" ")).otherwise(F.col("target_clean")), "substitute": F.when(size == 9, F.lit(None)).otherwise(F.col("substitute"))})
    out = pairs.word_records(pairs.word_scores(rows, BigramScorer(table(spark, sf_dir, "part").select(F.col("p_name").alias("text"))), "parts"))
    return rounded(out.drop("orig_token_ids", "sub_token_ids").withColumns({"orig_tokens": F.array_join("orig_tokens", " "), "sub_tokens": F.array_join("sub_tokens", " ")}))


@query
def missing_words(spark, sf_dir):
    """How many rows lack a target or a substitute, or are left out for another reason."""
    rows = word_rows(spark, sf_dir)
    size = F.col("row_idx") % 10
    rows = rows.withColumns({"target_clean": F.when(size == 8, F.lit(" ")).otherwise(F.col("target_clean")), "substitute": F.when(size == 9, F.lit(None)).otherwise(F.col("substitute"))})
    return lexsub.build_examples(rows).groupBy("reason").agg(F.count("*").alias("n"))


@query
def nested_stats(spark, sf_dir):
    """Statistics by group as one nested, sorted document, written and read again."""
    path = f"{scratch_path(spark, 'summary')}/stats.json"
    rows = stats.by_groups(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), "l_quantity", ["l_returnflag", "l_linestatus"])
    writers.write_summary(spark, path, stats.nested(rows))
    kind = "n bigint, mean double, median double, std double, min double, max double, frac_positive double"
    doc = spark.read.schema(f"all struct<{kind.replace(' ', ':').replace(',:', ',')}>, by map<string,map<string,struct<{kind.replace(' ', ':').replace(',:', ',')}>>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    inner = doc.select(F.explode("by").alias("grouping", "m")).select("grouping", F.explode("m").alias("key", "s")).unionByName(doc.select(F.lit("all").alias("grouping"), F.lit(None).cast("string").alias("key"), F.col("all").alias("s")))
    return rounded(inner.select("grouping", "key", "s.*"), 4)


@query
def compare_document(spark, sf_dir):
    """A comparison of two samples as a document, written and read again."""
    path = f"{scratch_path(spark, 'compare')}/compare.json"
    rows = event_scores(spark, sf_dir)
    out = stats.compare(rows.where("event_type = 'click'"), rows.where("event_type <> 'click'"), "score", stats.stats_word(F.col("score"), F.col("orig_logp"), F.col("sub_logp")), stats.medians_of(F.col("score")))
    writers.write_summary(spark, path, json.loads(out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]))
    kind = "old struct<n:bigint,mean:double,median:double>, new struct<n:bigint,mean:double,median:double>, difference_mean_old_minus_new double, auc_old_higher_than_new double, cohens_d_old_minus_new double"
    got = spark.read.schema(kind).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rounded(got.select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("old", "new") for c in ("n", "mean", "median")), "difference_mean_old_minus_new", "auc_old_higher_than_new", "cohens_d_old_minus_new"))


@query
def output_paths(spark, sf_dir):
    """Where the summary and the skipped rows of an output go."""
    names = [f"{r['r_name'].lower()}{end}" for r in table(spark, sf_dir, "region").collect() for end in (".jsonl", ".csv", ".json", "/")]
    return spark.createDataFrame([tuple(writers.derived_paths(n)[k] for k in ("records", "summary", "skipped")) for n in names], "records string, summary string, skipped string")
