"""The pipelines from paired texts to records: numbers, programs, substituted words and whole contexts.

Each takes a scorer (see ``spanlens.functions.scorer``). Cheap filters come before the scorer, payload columns are joined
after it, and each text is scored once. What is found in the texts (pairs, spans, reasons) is written to the scratch folder
before it is used: it is needed several times and would otherwise be found anew each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.functions.text import align_numbers, finite, numbers
from spanlens.operators.lexsub import build_examples, first_reason, stop_after
from spanlens.operators.locate import locate_span
from spanlens.operators.overlap import overlap_join, paired, span_costs, text_costs
from spanlens.sources.scratch import staged

# Fixed value: what stands before a problem when it is scored.
PROBLEM_PREFIX = "Problem: "


def level_filter(rows: DataFrame, levels: str | None) -> DataFrame:
    """Rows whose trimmed level is in a comma-separated list; ``all`` in any case, or None, keeps every row, an empty list none."""
    if levels is None or levels.strip().lower() == "all":
        return rows
    allowed = [x.strip() for x in levels.split(",") if x.strip()]
    return rows.where(F.trim(F.col("level").cast("string")).isin(*allowed)) if allowed else rows.where(F.lit(False))


def number_pairs(rows: DataFrame, key: str = "row_id", original: str = "original_problem", perturbed: str = "problem", changed_only: bool = True) -> DataFrame:
    """(key, num_index, offsets and texts of both numbers, changed, count_mismatch, counts): a row for each aligned pair."""
    pairs = align_numbers(numbers(F.col(original)), numbers(F.col(perturbed)))
    out = rows.select(key, F.explode(pairs).alias("p")).select(key, "p.*")
    return out.where("changed") if changed_only else out


def _scored_spans(texts: DataFrame, spans: DataFrame, scorer, keys: list[str]) -> DataFrame:
    """Tokens of ``texts`` (keys, text) that overlap ``spans``, with their costs."""
    if hasattr(scorer, "tokens") and hasattr(scorer, "nll"):  # only tokens in spans need a cost
        return scorer.nll(overlap_join(scorer.tokens(texts), spans, keys))
    ident = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    tokens = scorer.score(texts.select(ident.alias("text_id"), "text"))
    return overlap_join(tokens, spans.withColumn("text_id", ident), ["text_id"])


def number_records(rows: DataFrame, scorer, key: str = "row_id", prefix: str = PROBLEM_PREFIX, original: str = "original_problem", perturbed: str = "problem") -> DataFrame:
    """(key, num_index, both numbers, flags, sum, mean and number of tokens of both sides, deltas) of the changed pairs that can be scored."""
    pairs = staged(number_pairs(rows, key, original, perturbed), "number-pairs")
    shift = len(prefix)
    side = lambda name: F.struct(F.lit(name).alias("side"), (F.col(f"{name}_start") + shift).alias("span_start"), (F.col(f"{name}_end") + shift).alias("span_end"))
    spans = pairs.select(key, "num_index", F.explode(F.array(side("orig"), side("pert"))).alias("s")).select(key, "num_index", "s.*")
    sided = F.array(*(F.struct(F.lit(n).alias("side"), F.concat(F.lit(prefix), F.col(c)).alias("text")) for n, c in (("orig", original), ("pert", perturbed))))
    texts = rows.join(pairs.select(key).distinct(), key, "left_semi").select(key, F.explode(sided).alias("t")).select(key, "t.*")
    costs = span_costs(_scored_spans(texts, spans, scorer, [key, "side"]), [key, "num_index", "side"])
    both = paired(costs, [key, "num_index"], "orig", "pert").where("orig_sum_nll is not null and pert_sum_nll is not null")
    about = pairs.select(key, "num_index", "orig_num", "pert_num", "count_mismatch", "orig_num_count", "pert_num_count")
    out = both.join(about, [key, "num_index"])
    return out.withColumns({"delta_sum_nll": F.col("pert_sum_nll") - F.col("orig_sum_nll"), "delta_mean_nll": F.col("pert_mean_nll") - F.col("orig_mean_nll")})


def number_report(rows: DataFrame, scorer, key: str = "row_id", **options) -> DataFrame:
    """The full records of number pairs: 21 columns, texts and answers joined last."""
    records = number_records(rows, scorer, key, **options)
    own = rows.select(key, "idx", "type", "level", "original_problem", F.col("problem").alias("perturbed_problem"), "original_answer", "answer")
    return records.join(own, key).select(
        "idx", "type", "level", "orig_num", "pert_num", "num_index", "count_mismatch", "orig_num_count", "pert_num_count",
        "orig_sum_nll", "pert_sum_nll", "delta_sum_nll", "orig_mean_nll", "pert_mean_nll", "delta_mean_nll", "orig_num_tokens", "pert_num_tokens",
        "original_problem", "perturbed_problem", "original_answer", "answer",
    )


CODE_FIELDS = ("name", "variant_id", "fix_span", "solution_line", "mutation_type", "solution")


def code_scores(rows: DataFrame, scorer, key: str = "row_id", skip_token_count_mismatch: bool = False) -> DataFrame:
    """``rows`` of program pairs with located spans, costs of both sides and ``reason``, null for records.

    Read ``span`` where the input has it (see ``read_code_pairs``), else ``buggy_span``, else ``original_span``. Both sides use
    the same start and line index, each its own line."""
    null = F.lit(None).cast("string")
    at = lambda c, kind="string": F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    span = at("span") if "span" in rows.columns else F.coalesce(at("buggy_span"), at("original_span"))
    own = rows.withColumns({"_span": span, "_cf_span": at("counterfactual_span")})
    program, other = at("original_buggy_program"), at("counterfactual_buggy_program")
    absent = lambda c: c.isNull() | (c == "")
    early = first_reason(
        (absent(program) | absent(other), "missing original_buggy_program or counterfactual_buggy_program"),
        (absent(F.col("_span")) | absent(F.col("_cf_span")), "missing buggy_span/original_span or counterfactual_span"),
    )
    own = own.withColumn("_early", early)
    hints = {"span_start": at("span_start", "int"), "line_index": at("line_index", "int")}
    located = own.withColumns(
        {
            "_o": F.when(F.col("_early").isNull(), locate_span(program, F.col("_span"), at("buggy_line"), **hints)),
            "_c": F.when(F.col("_early").isNull(), locate_span(other, F.col("_cf_span"), at("counterfactual_line"), **hints)),
        }
    )
    side = lambda n, c, text: F.struct(F.lit(n).alias("side"), text.alias("text"), F.col(f"{c}.start").alias("span_start"), F.col(f"{c}.end").alias("span_end"))
    keep = [key, *(c for c in ("name", "variant_id", "fix_span", "solution_line", "mutation_type", "solution", "buggy_line", "counterfactual_line", "original_buggy_program", "counterfactual_buggy_program") if c in rows.columns)]
    located = staged(located.select(*keep, "_span", "_cf_span", "_o", "_c", "_early"), "located-spans")
    lost = F.col("_early").isNull() & (F.col("_o.start").isNull() | F.col("_c.start").isNull())
    located = located.withColumn("_early", F.coalesce("_early", first_reason((lost, "could_not_locate_span"))))
    sides = located.where("_early is null").select(key, F.explode(F.array(side("orig", "_o", program), side("cf", "_c", other))).alias("s")).select(key, "s.*")
    joined = _scored_spans(sides.select(key, "side", "text"), sides.select(key, "side", "span_start", "span_end"), scorer, [key, "side"])
    costs = span_costs(joined, [key, "side"], token_lists=True)
    both = paired(costs, [key], "orig", "cf", ("sum_nll", "mean_nll", "num_tokens", "tokens"))
    out = located.join(both, key, "left")
    empty = (F.coalesce("orig_num_tokens", F.lit(0)) == 0) | (F.coalesce("cf_num_tokens", F.lit(0)) == 0)
    mismatch = F.coalesce(F.col("orig_num_tokens") != F.col("cf_num_tokens"), F.lit(False))
    late = first_reason((empty, "empty_or_unscorable_span"), (mismatch & F.lit(skip_token_count_mismatch), "token_count_mismatch"))
    none = F.array().cast("array<string>")
    return out.select(
        key, *(at(c).alias(c) for c in CODE_FIELDS), F.col("_span").alias("buggy_span"), F.col("_cf_span").alias("counterfactual_span"),
        at("buggy_line").alias("buggy_line"), at("counterfactual_line").alias("counterfactual_line"),
        F.col("_o.start").alias("orig_span_start"), F.col("_o.end").alias("orig_span_end"), F.col("_c.start").alias("cf_span_start"), F.col("_c.end").alias("cf_span_end"),
        F.coalesce("_o.mode", null).alias("orig_loc_mode"), F.coalesce("_c.mode", null).alias("cf_loc_mode"),
        "orig_sum_nll", "cf_sum_nll", (F.col("cf_sum_nll") - F.col("orig_sum_nll")).alias("delta_sum_nll"),
        "orig_mean_nll", "cf_mean_nll", (F.col("cf_mean_nll") - F.col("orig_mean_nll")).alias("delta_mean_nll"),
        F.coalesce("orig_num_tokens", F.lit(0)).alias("orig_num_tokens"), F.coalesce("cf_num_tokens", F.lit(0)).alias("cf_num_tokens"),
        mismatch.alias("token_count_mismatch"), F.coalesce("orig_tokens", none).alias("orig_tokens"), F.coalesce("cf_tokens", none).alias("cf_tokens"),
        program.alias("original_buggy_program"), other.alias("counterfactual_buggy_program"), F.coalesce("_early", late).alias("reason"),
    )


CODE_RECORD = (
    "name variant_id buggy_span fix_span counterfactual_span buggy_line counterfactual_line solution_line orig_span_start orig_span_end cf_span_start "
    "cf_span_end orig_loc_mode cf_loc_mode orig_sum_nll cf_sum_nll delta_sum_nll orig_mean_nll cf_mean_nll delta_mean_nll orig_num_tokens cf_num_tokens "
    "token_count_mismatch orig_tokens cf_tokens mutation_type original_buggy_program counterfactual_buggy_program solution"
).split()


def code_records(scores: DataFrame) -> DataFrame:
    return scores.where("reason is null").select(*CODE_RECORD)


def code_skipped(scores: DataFrame) -> DataFrame:
    """The rows that are no records, with their reason and what was known by then."""
    cost = lambda s: F.struct(F.col(f"{s}_sum_nll").alias("sum_nll"), F.col(f"{s}_mean_nll").alias("mean_nll"), F.col(f"{s}_num_tokens").alias("num_tokens"), F.col(f"{s}_tokens").alias("tokens"))
    unscored = F.col("reason") == "empty_or_unscorable_span"
    unlocated = F.col("reason") == "could_not_locate_span"
    return scores.where("reason is not null").select(
        "name", "reason", "orig_loc_mode", "cf_loc_mode", F.when(unlocated, F.col("buggy_span")).alias("orig_span"), F.when(unlocated, F.col("counterfactual_span")).alias("cf_span"),
        F.when(unscored, cost("orig")).alias("orig_score"), F.when(unscored, cost("cf")).alias("cf_score"),
        F.when(F.col("reason") == "token_count_mismatch", F.col("orig_num_tokens")).alias("orig_num_tokens"), F.when(F.col("reason") == "token_count_mismatch", F.col("cf_num_tokens")).alias("cf_num_tokens"),
    )


def continuation_costs(examples: DataFrame, scorer, key: str, side: str, word: str, single: bool = True, max_tokens: int | None = None) -> DataFrame:
    """(key, side_logp, side_tokens, side_token_ids, side_num_tokens, side_problem): the word's cost after the prefix.

    Problems in order: a token sticks out over other text on the left or right, the word has no token, not one token (if ``single``),
    a text over ``max_tokens``, and no context for its first token."""
    texts = examples.select(F.col(key).cast("string").alias("text_id"), F.concat("prefix", word).alias("text"), F.char_length("prefix").alias("_start"))
    tokens = scorer.score(texts.select("text_id", "text"))
    n = tokens.groupBy("text_id").agg(F.count("*").alias("_n"))
    spans = texts.select("text_id", "text", F.col("_start").alias("span_start"), F.char_length("text").alias("span_end"))
    hit = overlap_join(tokens, spans, ["text_id"], empty_tokens=True)
    sticks = (F.col("char_start") < F.col("span_start")) & F.substring(F.col("text"), F.col("char_start") + 1, F.col("span_start") - F.col("char_start")).rlike(r"(?U)[^\s\x1C-\x1F]")
    over = (F.col("char_end") > F.col("span_end")) & F.substring(F.col("text"), F.col("span_end") + 1, F.col("char_end") - F.col("span_end")).rlike(r"(?U)[^\s\x1C-\x1F]")
    cost = finite(F.col("nll"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "token", "token_id")))
    own = hit.groupBy("text_id").agg(
        (-F.sum(cost)).alias("_logp"), F.count("*").cast("int").alias("_k"), F.min("pos").alias("_first"), F.max(sticks.cast("int")).alias("_sticks"), F.max(over.cast("int")).alias("_over"), listed.alias("_list")
    )
    own = texts.select("text_id").join(own, "text_id", "left").join(n, "text_id", "left")
    problem = first_reason(
        (F.col("_sticks") == 1, "token_crosses_left_nonspace"),
        (F.col("_over") == 1, "token_crosses_right_nonspace"),
        (F.coalesce("_k", F.lit(0)) == 0, "no_continuation_tokens"),
        (F.lit(single) & (F.col("_k") != 1), "not_one_token"),
        (F.lit(max_tokens is not None) & (F.col("_n") > (max_tokens or 0)), "too_long"),
        (F.col("_first") == 0, "no_context_for_first_token"),
    )
    return own.select(
        F.col("text_id").alias("_id"), F.col("_logp").alias(f"{side}_logp"), F.transform("_list", lambda x: x["token_id"]).alias(f"{side}_token_ids"),
        F.transform("_list", lambda x: x["token"]).alias(f"{side}_tokens"), F.coalesce("_k", F.lit(0)).alias(f"{side}_num_tokens"),
        F.when(problem.isNotNull(), F.concat(F.lit(f"{side}_"), problem)).alias(f"{side}_problem"),
    )


WORD_RECORD = (
    "row_idx dataset sentence changed_sentence prefix suffix target substitute orig_logp sub_logp orig_nll sub_nll score orig_token_ids sub_token_ids "
    "orig_tokens sub_tokens orig_num_tokens sub_num_tokens"
).split()


def word_scores(
    rows: DataFrame, scorer, dataset_label: str = "dataset", key: str = "row_idx", single_token: bool = True, max_tokens: int | None = None,
    max_examples: int | None = None, **columns,
) -> DataFrame:
    """Word records with ``reason``, null for the scored ones. Only ``prefix`` and the word are scored, not the suffix.

    Texts over ``max_tokens``, or over what the scorer says is its limit, are not scored."""
    if max_tokens is None and hasattr(scorer, "limit"):
        max_tokens = scorer.limit()
    built = staged(build_examples(rows, **columns), "word-examples")
    good = built.where("reason is null").select(key, "prefix", "target", "substitute")
    orig = continuation_costs(good, scorer, key, "orig", "target", single_token, max_tokens)
    sub = continuation_costs(good, scorer, key, "sub", "substitute", single_token, max_tokens)
    out = built.join(orig, F.col(key).cast("string") == orig["_id"], "left").drop("_id").join(sub, F.col(key).cast("string") == sub["_id"], "left").drop("_id")
    out = out.withColumn("reason", F.coalesce("reason", "orig_problem", "sub_problem")).select(
        F.col(key).alias("row_idx"), F.lit(dataset_label).alias("dataset"), "sentence", F.concat("prefix", "substitute", "suffix").alias("changed_sentence"),
        "prefix", "suffix", "target", "substitute", "orig_logp", "sub_logp", (-F.col("orig_logp")).alias("orig_nll"), (-F.col("sub_logp")).alias("sub_nll"),
        (F.col("orig_logp") - F.col("sub_logp")).alias("score"), "orig_token_ids", "sub_token_ids", "orig_tokens", "sub_tokens", "orig_num_tokens", "sub_num_tokens", "reason",
    )
    return out if max_examples is None else stop_after(out, max_examples)


def word_records(scores: DataFrame) -> DataFrame:
    return scores.where("reason is null").select(*WORD_RECORD)


def context_costs(texts: DataFrame, scorer) -> DataFrame:
    """(text_id, mean_nll, sum_nll, num_tokens) of whole texts; 0 for texts without a scored token."""
    ids = texts.select(F.col("text_id").cast("string").alias("text_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    costs = text_costs(scorer.score(ids), ["text_id"])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ids.select("text_id").join(costs, "text_id", "left").select("text_id", F.coalesce("mean_nll", F.lit(0.0)).alias("mean_nll"), F.coalesce("sum_nll", F.lit(0.0)).alias("sum_nll"), zero("num_tokens"))


def context_scores(rows: DataFrame, scorer, key: str = "row_idx", orig_col: str = "sentence", sub_col: str = "changed_sentence") -> DataFrame:
    """``rows`` with mean, sum and number of tokens of both sentences, ``context_score`` and log-probability columns."""
    side = lambda name, c: F.struct(F.lit(name).alias("side"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("text"))
    both = rows.select(F.col(key).cast("string").alias("row"), F.explode(F.array(side("orig", orig_col), side("sub", sub_col))).alias("s")).select("row", "s.*")
    ids = both.select(F.to_json(F.struct("row", "side"), {"ignoreNullFields": "false"}).alias("text_id"), "text")
    costs = context_costs(ids, scorer).select(F.from_json("text_id", "row string, side string").alias("i"), "mean_nll", "sum_nll", "num_tokens")
    costs = paired(costs.select("i.row", "i.side", "mean_nll", "sum_nll", "num_tokens"), ["row"], "orig", "sub", ("mean_nll", "sum_nll", "num_tokens"))
    costs = costs.select(F.col("row").alias("_id"), *(F.col(f"{n}_{c}").alias(f"{n}_context_{c}") for n in ("orig", "sub") for c in ("mean_nll", "sum_nll", "num_tokens")))
    own = rows.join(costs, F.col(key).cast("string") == F.col("_id"), "left").drop("_id")
    orig, sub = F.col("orig_context_mean_nll"), F.col("sub_context_mean_nll")
    return own.withColumns({"context_score": sub - orig, "orig_context_avg_logp": -orig, "sub_context_avg_logp": -sub, "context_logp_score": sub - orig})

