"""Command lines: ``python -m spanlens math|code|word|context|prolex|swords|plot`` with the options of each program.

A model named by ``--model`` needs torch and transformers; ``--bigram CORPUS`` scores with counts of a text table instead.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.functions.scorer import BigramScorer, TransformerScorer
from spanlens.operators import lexsub, stats
from spanlens.plans import pairs
from spanlens.sources import readers, writers
from spanlens.sources.scratch import staged


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanlens", description=__doc__)
    sub = top.add_subparsers(dest="program", required=True)

    def model(p, required=True, default=None):
        p.add_argument("--model", default=default)
        p.add_argument("--bigram", help="Parquet or text lines to count instead of a model")
        p.add_argument("--dtype", default="auto")
        p.add_argument("--device_map", default="auto")
        p.add_argument("--trust_remote_code", action="store_true")
        p.add_argument("--cache_dir")

    p = sub.add_parser("math")
    model(p)
    p.add_argument("--dataset", required=True)
    p.add_argument("--split", default="test")
    p.add_argument("--max_samples", type=int)
    p.add_argument("--levels", default="Level 1,Level 2,Level 3")
    p.add_argument("--max_length", type=int, default=2048)
    p.add_argument("--out_jsonl", required=True)
    p.add_argument("--out_summary")

    p = sub.add_parser("code")
    model(p)
    p.add_argument("--input_jsonl", required=True)
    p.add_argument("--out_jsonl", required=True)
    p.add_argument("--out_summary")
    p.add_argument("--max_length", type=int, default=4096)
    p.add_argument("--skip_token_count_mismatch", action="store_true")

    for name in ("word", "context"):
        p = sub.add_parser(name)
        p.add_argument("--mode", choices=("run", "compare"), default="run")
        model(p)
        p.add_argument("--out")
        p.add_argument("--old_csv")
        p.add_argument("--new_csv")
        p.add_argument("--compare_out")
        if name == "word":
            p.add_argument("--data")
            p.add_argument("--dataset_label", default="dataset")
            p.add_argument("--max_examples", type=int)
            p.add_argument("--max_positions", type=int)
            p.add_argument("--no_single_token_filter", action="store_true")
            p.add_argument("--allow_repeated_target", action="store_true")
            p.add_argument("--no_match_case", action="store_true")
            for flag, column in (("sentence_col", "clean_sentence"), ("target_col", "target_clean"), ("sub_col", "substitute"), ("prefix_col", "prefix"), ("suffix_col", "suffix"), ("marked_sentence_col", "Sentence")):
                p.add_argument(f"--{flag}", default=column)
        else:
            p.add_argument("--input")
            p.add_argument("--orig_col", default="sentence")
            p.add_argument("--sub_col", default="changed_sentence")
            p.add_argument("--batch_size", type=int, default=8)
            p.add_argument("--max_length", type=int)

    p = sub.add_parser("prolex")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--sub_col", default="acc_subs")
    p.add_argument("--explode", action="store_true")

    p = sub.add_parser("swords")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--all_output")
    p.add_argument("--n", type=int, default=1753)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--min_true", type=float, default=0.5)
    p.add_argument("--allow_repeated_target", action="store_true")

    p = sub.add_parser("plot")
    p.add_argument("--input", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--title", default="")
    p.add_argument("--bins", type=int, default=50)
    p.add_argument("--density", action="store_true")
    p.add_argument("--orig_col", default="orig_nll")
    p.add_argument("--sub_col", default="sub_nll")
    for axis in "xy":
        p.add_argument(f"--{axis}lim", type=float, nargs=2)
    return top


def scorer_of(spark: SparkSession, a):
    if a.bigram:
        corpus = spark.read.parquet(a.bigram) if a.bigram.rstrip("/").endswith(".parquet") else spark.read.text(a.bigram).withColumnRenamed("value", "text")
        return BigramScorer(corpus.select("text"))
    if not a.model:
        raise SystemExit("name a --model, or a --bigram corpus")
    return TransformerScorer(a.model, getattr(a, "max_length", None), a.dtype, a.device_map, a.trust_remote_code, a.cache_dir, getattr(a, "batch_size", 8))


def as_dict(df: DataFrame) -> dict:
    return json.loads(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"])


def stats_by(records: DataFrame, value: str) -> dict:
    out = stats.nested(stats.by_groups(records, value, ["type", "level"]))
    return ({"all": out["all"]} if out["all"] is not None else {}) | out["by"]


def run_math(spark, a) -> dict:
    local = a.dataset.endswith((".json", ".jsonl", ".jsonl.gz", ".parquet"))
    rows = readers.read_dataset(spark, a.dataset) if local else readers.read_snapshot(spark, a.dataset, a.split)
    readers.require_columns(rows, ["original_problem", "problem"] + (["level"] if a.levels and a.levels.lower() != "all" else []))
    rows = readers.with_ordinal(pairs.level_filter(rows, a.levels), "row_id")
    if a.max_samples is not None:
        rows = rows.orderBy("row_id").limit(a.max_samples)
    paths = writers.derived_paths(a.out_jsonl)
    records = staged(pairs.number_report(rows, scorer_of(spark, a)), "records")
    writers.write_json_lines(records, paths["records"])
    sums, means = stats_by(records, "delta_sum_nll"), stats_by(records, "delta_mean_nll")
    summary = {"delta_sum_nll": sums.get("all", {}), "delta_mean_nll": means.get("all", {}), "by_type": sums.get("type", {}), "by_level": sums.get("level", {})}
    n = records.agg(F.count("*").alias("num_records"), F.count_if("count_mismatch").alias("num_count_mismatch_records"))
    summary |= as_dict(n) | {"model": a.model, "dataset": a.dataset, "split": a.split, "levels": a.levels}
    print(writers.write_summary(spark, a.out_summary or paths["summary"], summary))
    return summary


def run_code(spark, a) -> dict:
    rows = readers.with_ordinal(readers.read_code_pairs(spark, a.input_jsonl), "row_id")
    scores = staged(pairs.code_scores(rows, scorer_of(spark, a), skip_token_count_mismatch=a.skip_token_count_mismatch), "scores")
    paths = writers.derived_paths(a.out_jsonl)
    records, skipped = pairs.code_records(scores), pairs.code_skipped(scores)
    writers.write_json_lines(records, paths["records"])
    writers.write_json_lines(skipped, paths["skipped"])
    summary = {c: as_dict(stats.grouped(records, [], stats.stats_code(c), stats.medians_of(F.col(c)))) for c in ("delta_sum_nll", "delta_mean_nll")}
    summary |= as_dict(records.agg(F.count("*").alias("num_records"), F.count_if("token_count_mismatch").alias("num_token_count_mismatch"), F.count_if(F.col("delta_sum_nll") > 0).alias("num_positive")))
    summary |= {"num_input": scores.count(), "num_skipped": skipped.count(), "model": a.model, "input": a.input_jsonl}
    print(writers.write_summary(spark, a.out_summary or paths["summary"], summary))
    lexsub.reason_counts(scores).orderBy("reason").show(truncate=False)
    return summary


def compared(spark, a, score: str, stats_of) -> dict:
    if not a.old_csv or not a.new_csv:
        raise SystemExit("compare needs --old_csv and --new_csv")
    numeric = lambda df: df.select(*(F.col(c).cast("double").alias(c) for c in df.columns if c in NUMERIC))
    old, new = (numeric(readers.read_csv(spark, p)) for p in (a.old_csv, a.new_csv))
    for df in (old, new):
        readers.require_columns(df, [score])
    out = {"old_file": a.old_csv, "new_file": a.new_csv} | as_dict(stats.compare(old, new, score, stats_of, stats.medians_of(F.col(score))))
    if a.compare_out:
        writers.write_summary(spark, a.compare_out, out)
    print(json.dumps(out, indent=2))
    return out


NUMERIC = ("score", "orig_logp", "sub_logp", "context_score", "orig_context_mean_nll", "sub_context_mean_nll")


def run_word(spark, a) -> dict:
    of = stats.stats_word(F.col("score"), F.col("orig_logp"), F.col("sub_logp"))
    if a.mode == "compare":
        return compared(spark, a, "score", of)
    rows = readers.with_ordinal(readers.read_csv(spark, a.data), "row_idx")
    columns = {c: getattr(a, c) for c in ("sentence_col", "target_col", "sub_col", "prefix_col", "suffix_col", "marked_sentence_col", "allow_repeated_target")}
    scores = pairs.word_scores(rows, scorer_of(spark, a), a.dataset_label, "row_idx", not a.no_single_token_filter, a.max_positions, a.max_examples, use_match_case=not a.no_match_case, **columns)
    scores = staged(scores, "scores")
    records = pairs.word_records(scores)
    writers.write_csv(records, a.out)
    summary = as_dict(stats.grouped(records, [], of, stats.medians_of(F.col("score")))) | {"num_input_rows": rows.count(), "kept": records.count(), "skip": {r["reason"]: r["n"] for r in lexsub.reason_counts(scores).orderBy("reason").collect()}}
    print(writers.write_summary(spark, writers.derived_paths(a.out)["summary"], summary | {"model": a.model, "data": a.data}))
    return summary


def run_context(spark, a) -> dict:
    of = stats.stats_context(F.col("context_score"), F.col("orig_context_mean_nll"), F.col("sub_context_mean_nll"))
    if a.mode == "compare":
        return compared(spark, a, "context_score", of)
    rows = readers.read_csv(spark, a.input)
    readers.require_columns(rows, [a.orig_col, a.sub_col])
    numbered = readers.with_ordinal(rows, "_ordinal")
    scores = staged(pairs.context_scores(numbered, scorer_of(spark, a), "_ordinal", a.orig_col, a.sub_col), "scores").drop("_ordinal")
    writers.write_csv(scores, a.out)
    summary = as_dict(stats.grouped(scores, [], of, stats.medians_of(F.col("context_score"))))
    print(writers.write_summary(spark, writers.derived_paths(a.out)["summary"], summary | {"model": a.model, "input": a.input}))
    return summary


def run_prolex(spark, a) -> dict:
    out = staged(lexsub.filter_marked(readers.read_csv(spark, a.input), a.sub_col, a.explode), "marked")
    writers.write_csv(out, a.output)
    summary = {"rows": out.count()}
    print(json.dumps(summary))
    return summary


def run_swords(spark, a) -> dict:
    judged = staged(lexsub.judge_substitutions(lexsub.unpack_substitutions(readers.read_substitutions(spark, a.input)), a.min_true, a.allow_repeated_target), "judged")
    kept = judged.where("reason is null").drop("reason")
    if a.all_output:
        writers.write_csv(kept, a.all_output)
    writers.write_csv(lexsub.exact_sample(kept, a.n, "source_substitute_id", a.seed), a.output)
    summary = {"kept": kept.count(), "sampled": a.n, "skipped": {r["reason"]: r["n"] for r in lexsub.substitution_reasons(judged).orderBy("reason").collect()}}
    print(json.dumps(summary, indent=2))
    return summary


def run_plot(spark, a) -> dict:
    rows = readers.read_csv(spark, a.input)
    readers.require_columns(rows, [a.orig_col, a.sub_col])
    own = rows.select(*(F.col(c).cast("double").alias(c) for c in (a.orig_col, a.sub_col)))
    bins = stats.histogram(own, [a.orig_col, a.sub_col], a.bins, a.density)
    means = own.agg(*(F.avg(c).alias(c) for c in own.columns)).first().asDict()
    print(json.dumps({"means": means, "sub_minus_orig": None if None in means.values() else means[a.sub_col] - means[a.orig_col]}))
    writers.draw_histogram(bins, a.out, a.title, a.density, means, a.xlim, a.ylim)
    return means


PROGRAMS = {"math": run_math, "code": run_code, "word": run_word, "context": run_context, "prolex": run_prolex, "swords": run_swords, "plot": run_plot}


def main(argv: list[str] | None = None) -> dict:
    a = parser().parse_args(argv)
    return PROGRAMS[a.program](SparkSession.builder.appName("spanlens").getOrCreate(), a)


if __name__ == "__main__":
    main()
