"""Scorers turn texts into token tables.

A scorer has ``score(texts)``: rows (text_id, text) to rows (text_id, pos, char_start, char_end, token_id, token, nll),
where ``nll`` is null at position 0 and where a token can't be scored. ``BigramScorer`` is made of built-in expressions and
trained here; ``TransformerScorer`` runs a causal language model where torch and transformers are installed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.functions.text import finite, running_sum
from spanlens.sources.scratch import staged

TOKEN = "[A-Za-z]+|[0-9]|[ \t\n\r\f]+|[^A-Za-z0-9 \t\n\r\f]+"
#: Pairs that a bigram model has at most, about 60 bytes each, if it is broadcast.
BROADCAST = 500_000
SCHEMA = "text_id string, pos int, char_start int, char_end int, token_id int, token string, nll double"


def token_table(texts: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """(text_id, pos, char_start, char_end, token, prev) of a tiling pattern; other columns of ``texts`` but ``text`` are kept.

    Offsets are running sums within the row, so the table is made without a shuffle. Null texts have no tokens."""
    found = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
    rest = [c for c in texts.columns if c != "text"]
    rows = texts.select(*rest, found.alias("tokens")).where(F.size("tokens") > 0)
    rows = rows.withColumn("starts", running_sum(F.transform("tokens", lambda t: F.char_length(t))))
    entry = F.zip_with("tokens", "starts", lambda t, s: F.struct(t.alias("token"), s.alias("char_start")))
    entry = F.transform(entry, lambda e, i: F.struct(e["token"].alias("token"), e["char_start"].alias("char_start"), F.get(F.col("tokens"), i - 1).alias("prev")))
    out = rows.select(*rest, F.posexplode(entry).alias("pos", "e"))
    return out.select(*rest, "pos", F.col("e.char_start"), (F.col("e.char_start") + F.char_length("e.token")).alias("char_end"), F.col("e.token"), F.col("e.prev"))


class BigramScorer:
    """A smoothed bigram model: nll = -ln((c(prev, token) + alpha) / (c(prev) + alpha * V)).

    ``corpus`` has a column ``text``. Counts stay tables; each distinct (prev, token) is looked up once, then joined to its
    occurrences, so a very frequent context is looked up once too."""

    def __init__(self, corpus: DataFrame, alpha: float = 0.5):
        self.alpha = alpha
        self._small: bool | None = None
        tokens = F.regexp_extract_all("text", F.lit(f"({TOKEN})"), F.lit(1))
        pairs = F.transform(F.col("t"), lambda x, i: F.struct(F.get(F.col("t"), i - 1).alias("prev"), x.alias("token")))
        counts = corpus.select(tokens.alias("t")).select(F.explode(pairs).alias("p")).groupBy("p.prev", "p.token").agg(F.count("*").alias("n"))
        self.counts = staged(counts.select("prev", "token", "n"), "bigram-counts")  # else each use would count the corpus anew
        self.pairs = self.counts.where("prev is not null")
        self.contexts = self.pairs.groupBy("prev").agg(F.sum("n").alias("context_n"))
        self.vocabulary = self.counts.agg(F.count_distinct("token").alias("v"))

    def tokens(self, texts: DataFrame) -> DataFrame:
        return token_table(texts)

    def small(self) -> bool:
        """Whether the model has few enough pairs to be sent to every executor."""
        if self._small is None:
            self._small = self.counts.count() <= BROADCAST
        return self._small

    def nll(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` with ``nll``, without ``prev``. A small model is broadcast, so that no token moves; of a large one each
        distinct pair is looked up once."""
        pairs = self.pairs.select("prev", "token", F.col("n").alias("_n"))
        contexts = self.contexts.select("prev", F.col("context_n").alias("_context_n"))
        kinds = F.broadcast(self.vocabulary.select(F.col("v").alias("_v")))
        seen = F.coalesce(F.col("_n"), F.lit(0)) + F.lit(self.alpha)
        room = F.coalesce(F.col("_context_n"), F.lit(0)) + F.lit(self.alpha) * F.col("_v")
        cost = (-F.ln(seen / room)).alias("nll")
        if self.small():
            known = tokens.join(F.broadcast(pairs), ["prev", "token"], "left").join(F.broadcast(contexts), "prev", "left").join(kinds)
            return known.withColumn("nll", F.when(F.col("prev").isNotNull(), cost)).drop("prev", "_n", "_context_n", "_v")
        asked = tokens.where("prev is not null").select("prev", "token").distinct()
        known = asked.join(pairs, ["prev", "token"], "left").join(contexts, "prev", "left").join(kinds)
        return tokens.join(known.select("prev", "token", cost), ["prev", "token"], "left").drop("prev")

    def score(self, texts: DataFrame) -> DataFrame:
        return self.nll(self.tokens(texts)).select("text_id", "pos", "char_start", "char_end", F.hash("token").alias("token_id"), "token", "nll")


class TransformerScorer:
    """A causal language model by its name or folder, loaded once in each Python worker. Needs torch and transformers.

    No special tokens are added; texts are cut at ``max_length`` tokens, so that later spans can't be scored; costs are
    computed in 32-bit floats whatever the model's type. ``batch_size`` texts go through the model at once, padded on the
    right and masked, so that padding changes no cost."""

    def __init__(self, model: str, max_length: int | None = 2048, dtype: str = "auto", device_map: str | None = "auto", trust_remote_code: bool = False, cache_dir: str | None = None, batch_size: int = 8):
        self.model, self.max_length, self.dtype, self.device_map = model, max_length, dtype, device_map
        self.trust_remote_code, self.cache_dir, self.batch_size = trust_remote_code, cache_dir, batch_size

    def limit(self) -> int | None:
        """How many positions the model has, by its configuration."""
        from transformers import AutoConfig

        config = AutoConfig.from_pretrained(self.model, trust_remote_code=self.trust_remote_code, cache_dir=self.cache_dir)
        known = (getattr(config, name, None) for name in ("max_position_embeddings", "n_positions", "n_ctx"))
        return next((n for n in known if isinstance(n, int) and n > 0), None)

    def score(self, texts: DataFrame) -> DataFrame:
        own = dict(vars(self))

        def run(frames):
            import pandas as pd

            model, tokenizer, torch = _loaded(own)
            for frame in frames:
                for a in range(0, len(frame), own["batch_size"]):
                    part = frame.iloc[a : a + own["batch_size"]]
                    enc = tokenizer([x or "" for x in part["text"]], add_special_tokens=False, return_offsets_mapping=True, truncation=own["max_length"] is not None, max_length=own["max_length"])
                    rows = []
                    for text_id, ids, offsets, cost in zip(part["text_id"], enc["input_ids"], enc["offset_mapping"], _costs(model, tokenizer, torch, enc["input_ids"]), strict=True):
                        names = tokenizer.convert_ids_to_tokens(ids)
                        rows += [(text_id, i, s, e, t, n, c) for i, ((s, e), t, n, c) in enumerate(zip(offsets, ids, names, cost, strict=True))]
                    yield pd.DataFrame(rows, columns=["text_id", "pos", "char_start", "char_end", "token_id", "token", "nll"])

        return texts.select(F.col("text_id").cast("string").alias("text_id"), "text").mapInPandas(run, SCHEMA).withColumn("nll", finite(F.col("nll")))


def _costs(model, tokenizer, torch, ids: list[list[int]]) -> list[list[float | None]]:
    """Costs of the tokens of each text, None for first ones, by one pass over a padded batch."""
    size = max(map(len, ids), default=0)
    if size < 2:
        return [[None] * len(x) for x in ids]
    device = model.get_input_embeddings().weight.device
    x = torch.tensor([row + [tokenizer.pad_token_id] * (size - len(row)) for row in ids], device=device)
    mask = torch.tensor([[1] * len(row) + [0] * (size - len(row)) for row in ids], device=device)
    with torch.no_grad():
        logits = model(input_ids=x, attention_mask=mask, use_cache=False).logits[:, :-1].float()
    cost = torch.nn.functional.cross_entropy(logits.transpose(1, 2), x[:, 1:], reduction="none").cpu().tolist()
    return [[None, *own[: len(row) - 1]] if row else [] for row, own in zip(ids, cost, strict=True)]


_MODELS: dict = {}


def _loaded(own: dict):
    key = (own["model"], own["dtype"], own["device_map"])
    if key not in _MODELS:
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        tokenizer = AutoTokenizer.from_pretrained(own["model"], use_fast=True, trust_remote_code=own["trust_remote_code"], cache_dir=own["cache_dir"])
        if not tokenizer.is_fast:
            raise ValueError("character offsets need a fast tokenizer")
        if tokenizer.pad_token_id is None:  # any id will do, as padding is masked
            tokenizer.pad_token = tokenizer.eos_token or tokenizer.unk_token
        tokenizer.padding_side = "right"
        kind = own["dtype"] if own["dtype"] == "auto" else getattr(torch, {"bf16": "bfloat16", "fp16": "float16", "fp32": "float32"}.get(own["dtype"], own["dtype"]))
        model = AutoModelForCausalLM.from_pretrained(own["model"], torch_dtype=kind, device_map=own["device_map"], trust_remote_code=own["trust_remote_code"], cache_dir=own["cache_dir"])
        _MODELS[key] = model.eval(), tokenizer, torch
    return _MODELS[key]
