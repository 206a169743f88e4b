"""Word substitution data: two dataset filters, examples built from rows, and the reasons why rows are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions.text import (
    count_separate, distinct_words, find_target, label_score, marked_target, match_case, one_word, parse_words, strip, without_marks,
)
from spanlens.sources.readers import require_columns, target_column, with_ordinal


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that is true; null if none is."""
    out = F.when(F.coalesce(checks[0][0], F.lit(False)), checks[0][1])
    for failed, reason in checks[1:]:
        out = out.when(F.coalesce(failed, F.lit(False)), reason)
    return out


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, n) of the rows that were left out."""
    return df.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))


def filter_marked(rows: DataFrame, sub_col: str = "acc_subs", explode: bool = False, sentence_col: str = "Sentence", ordinal: str | None = None) -> DataFrame:
    """Sentences with ``**target**`` and a written list of substitutes: rows whose target is one word, with its one-word
    substitutes that differ from it, each once whatever its case.

    A row for each substitute with ``explode``; otherwise one with the list, its first and its length. ``ordinal`` names a
    column that numbers the input rows; without it they are numbered here."""
    require_columns(rows, [sentence_col, sub_col])
    fallback = target_column(rows)
    if ordinal is None:
        rows, ordinal = with_ordinal(rows, "_ordinal"), "_ordinal"
    keep = [c for c in rows.columns if c != "_ordinal"]
    marked = marked_target(F.col(sentence_col))["target"]
    target = F.coalesce(strip(marked), strip(F.col(f"`{fallback}`").cast("string")))
    own = rows.withColumn("_target", target).where(one_word(F.col("_target")))
    subs = F.filter(F.transform(parse_words(F.col(sub_col)), strip), lambda s: one_word(s) & (F.lower(s) != F.lower(F.col("_target"))))
    own = own.withColumn("_subs", distinct_words(subs)).where(F.size("_subs") > 0)
    base = [*(F.col(f"`{c}`") for c in keep), without_marks(F.col(sentence_col)).alias("clean_sentence"), F.col("_target").alias("target_clean")]
    at = F.col(ordinal).alias("source_row_idx")
    if explode:
        return own.select(*base, F.explode("_subs").alias("substitute"), at)
    return own.select(*base, F.col("_subs").alias(f"{sub_col}_oneword"), F.get("_subs", F.lit(0)).alias("first_substitute"), F.size("_subs").alias("num_oneword_subs"), at)


def unpack_substitutions(data: DataFrame) -> DataFrame:
    """The four id-keyed maps of one substitution document as one table, a row per target and substitute.

    A target's context must exist; a target without substitutes has one row with a null substitute; substitutes without
    labels have an empty list."""
    targets = data.select(F.explode("targets").alias("target_id", "t")).select("target_id", "t.context_id", F.col("t.target").alias("target"), F.col("t.offset").alias("offset"), F.col("t.pos").alias("pos"))
    contexts = data.select(F.explode("contexts").alias("context_id", "c")).select("context_id", F.col("c.context").alias("context"))
    subs = data.select(F.explode("substitutes").alias("sid", "s")).select("sid", F.col("s.target_id").alias("target_id"), F.col("s.substitute").alias("substitute"))
    labels = data.select(F.explode("substitute_labels").alias("sid", "labels"))
    own = targets.join(contexts, "context_id", "left").withColumn("context", F.coalesce("context", F.raise_error(F.concat(F.lit("no context with id "), F.coalesce("context_id", F.lit("null"))))))
    own = own.join(subs, "target_id", "left").join(labels, "sid", "left")
    return own.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def judge_substitutions(rows: DataFrame, min_true: float = 0.5, allow_repeated_target: bool = False) -> DataFrame:
    """``rows`` (target_id, context, target, offset, pos, sid, substitute, labels) with ``reason``, null for rows to keep, and
    the columns of the result. Reasons about a target stand on every row of it."""
    target, sub = strip(F.col("target")), strip(F.col("substitute"))
    own = rows.withColumns({"_target": target, "_sub": sub, "_score": label_score(F.col("labels"))})
    size = F.char_length("_target")
    t = F.col("_target")
    checks = [
        (F.coalesce(F.substring("context", F.col("offset") + 1, size) != t, F.lit(True)), "bad_offset"),
        (~one_word(t), "target_not_one_word"),
        (F.lit(not allow_repeated_target) & (count_separate(F.col("context"), t) != 1), "target_repeated"),
        (~one_word(F.col("_sub")), "sub_not_one_word"),
        (F.lower("_sub") == F.lower(t), "same_as_target"),
        (F.col("_score") < min_true, "low_label_score"),
    ]
    own = own.withColumn("reason", first_reason(*checks)).where("sid is not null or reason in ('bad_offset', 'target_not_one_word', 'target_repeated')")
    return own.select(
        F.lit("swords").alias("dataset"), F.col("target_id").alias("source_target_id"), F.col("sid").alias("source_substitute_id"),
        F.col("context").alias("clean_sentence"), t.alias("target_clean"), F.col("_sub").alias("substitute"),
        F.substring("context", F.lit(1), F.col("offset")).alias("prefix"), F.substring(F.col("context"), F.col("offset") + size + 1, F.char_length("context")).alias("suffix"),
        F.col("offset").alias("target_offset"), "pos", F.col("_score").alias("label_score"), F.size("labels").alias("num_labels"), "reason",
    )


def substitution_reasons(judged: DataFrame) -> DataFrame:
    """(reason, n): reasons about a target count once a target, the others once a substitute."""
    of_target = F.col("reason").isin("bad_offset", "target_not_one_word", "target_repeated")
    targets = judged.where(of_target).select("reason", "source_target_id").distinct().select("reason")
    return reason_counts(targets.unionByName(judged.where(~of_target).select("reason")))


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement, chosen by a seeded hash of ``key``; an error if there are fewer."""
    have = df.count()
    if have < n:
        raise ValueError(f"only {have} rows, fewer than the {n} asked for")
    mark = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))
    return df.orderBy(mark, key).limit(n)


def build_examples(
    rows: DataFrame, sentence_col: str = "clean_sentence", target_col: str = "target_clean", sub_col: str = "substitute", prefix_col: str = "prefix",
    suffix_col: str = "suffix", marked_sentence_col: str = "Sentence", allow_repeated_target: bool = False, use_match_case: bool = True,
) -> DataFrame:
    """``rows`` with sentence, prefix, suffix, target, substitute and ``reason`` (null: to be scored).

    The target's place comes from the prefix and suffix columns if one of them has text, else from marks, else by search."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    sentence, target, sub = text(sentence_col), strip(text(target_col)), strip(text(sub_col))
    prefix, suffix = text(prefix_col), text(suffix_col)
    kept = [c for c in rows.columns if c.lower() not in ("sentence", "prefix", "suffix", "target", "substitute", "reason")]
    given = F.struct(
        F.lit(None).cast("string").alias("problem"), F.when(sentence == "", F.concat(prefix, target, suffix)).otherwise(sentence).alias("sentence"),
        prefix.alias("prefix"), target.alias("target"), suffix.alias("suffix"),
    )
    marks = marked_target(text(marked_sentence_col))
    marked = F.when(marks.isNotNull(), F.struct(F.lit(None).cast("string").alias("problem"), *(marks[c].alias(c) for c in ("sentence", "prefix", "target", "suffix"))))
    both = prefix_col in rows.columns and suffix_col in rows.columns
    searched = find_target(sentence, target, not allow_repeated_target)
    found = F.coalesce(marked, searched)
    if both:
        found = F.when((prefix != "") | (suffix != ""), given).otherwise(found)
    missing = F.struct(F.lit("missing_target_or_substitute").alias("problem"), *(F.lit(None).cast("string").alias(c) for c in ("sentence", "prefix", "target", "suffix")))
    own = rows.withColumn("_x", F.when((target == "") | (sub == ""), missing).otherwise(found)).withColumn("_sub", sub)
    own = own.withColumn("_target", strip(F.col("_x.target")))
    if use_match_case:
        own = own.withColumn("_sub", F.when(F.col("_target").isNotNull(), match_case(F.col("_sub"), F.col("_target"))).otherwise(F.col("_sub")))
    reason = F.coalesce(
        F.col("_x.problem"),
        first_reason((~one_word(F.col("_target")), "target_not_single_word"), (~one_word(F.col("_sub")), "sub_not_single_word"), (F.lower("_target") == F.lower("_sub"), "same_as_target")),
    )
    return own.select(
        *(F.col(f"`{c}`") for c in kept), F.col("_x.sentence").alias("sentence"), F.col("_x.prefix").alias("prefix"), F.col("_x.suffix").alias("suffix"),
        F.col("_target").alias("target"), F.col("_sub").alias("substitute"), reason.alias("reason"),
    )


def stop_after(rows: DataFrame, n: int, order: str = "row_idx", reason: str = "reason") -> DataFrame:
    """The rows up to the ``n``-th one that has no reason against it, by ``order``; all of them if there are fewer."""
    kept = rows.where(F.col(reason).isNull()).select(order).orderBy(order).limit(n)
    last = kept.agg(F.max(order).alias("_last"), F.count("*").alias("_n"))
    return rows.join(F.broadcast(last)).where((F.col("_n") < n) | (F.col(order) <= F.col("_last"))).drop("_last", "_n")


