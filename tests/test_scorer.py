"""The scorer of a causal language model, with small stand-ins for the libraries it needs."""

from __future__ import annotations

import math
import sys
import types

import numpy as np
import pytest

from spanlens.functions import scorer
from spanlens.plans import pairs

VOCABULARY = ["<pad>", *"abcdefghijklmnopqrstuvwxyz ."]


class Tensor:
    def __init__(self, x, device=None):
        self.x = np.asarray(x)

    def __getitem__(self, at):
        return Tensor(self.x[at])

    def float(self):
        return Tensor(self.x.astype(np.float32))

    def transpose(self, a, b):
        return Tensor(np.swapaxes(self.x, a, b))

    def cpu(self):
        return self

    def tolist(self):
        return self.x.tolist()


class Tokenizer:
    """A token a letter."""

    is_fast, pad_token_id, eos_token, unk_token = True, None, ".", None

    def __setattr__(self, name, value):
        object.__setattr__(self, name, value)
        if name == "pad_token":
            object.__setattr__(self, "pad_token_id", VOCABULARY.index(value))

    def __call__(self, texts, add_special_tokens, return_offsets_mapping, truncation, max_length):
        assert not add_special_tokens and return_offsets_mapping
        cut = [t[:max_length] if truncation else t for t in texts]
        return {"input_ids": [[VOCABULARY.index(c) for c in t] for t in cut], "offset_mapping": [[(i, i + 1) for i in range(len(t))] for t in cut]}

    def convert_ids_to_tokens(self, ids):
        return [VOCABULARY[i] for i in ids]


class Model:
    """Logits of the next letter from the mean of the ids so far that are not masked; it counts its calls."""

    calls: list = []

    def eval(self):
        return self

    def get_input_embeddings(self):
        return types.SimpleNamespace(weight=types.SimpleNamespace(device="cpu"))

    def __call__(self, input_ids, attention_mask, use_cache):
        x, m = input_ids.x, attention_mask.x
        assert not use_cache and x.shape == m.shape and (x[m == 0] == VOCABULARY.index(".")).all()
        Model.calls.append(x.shape)
        return types.SimpleNamespace(logits=Tensor(logits(x, m)))


def logits(x, m):
    mean = np.cumsum(x * m, axis=1) / np.maximum(1, np.cumsum(m, axis=1))
    return np.sin(mean[:, :, None] * np.arange(len(VOCABULARY)))


def cross_entropy(z, y, reduction):
    assert reduction == "none"
    z = np.swapaxes(z.x, 1, 2).astype(np.float64)
    own = np.take_along_axis(z, y.x[:, :, None], axis=2)[:, :, 0]
    return Tensor(np.log(np.exp(z).sum(axis=2)) - own)


class NoGrad:
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


TORCH = types.SimpleNamespace(tensor=Tensor, no_grad=NoGrad, nn=types.SimpleNamespace(functional=types.SimpleNamespace(cross_entropy=cross_entropy)), bfloat16="bf")


@pytest.fixture
def libraries(monkeypatch):
    made = []
    fake = types.ModuleType("transformers")
    fake.AutoTokenizer = types.SimpleNamespace(from_pretrained=lambda name, **o: Tokenizer())
    fake.AutoModelForCausalLM = types.SimpleNamespace(from_pretrained=lambda name, **o: made.append((name, o)) or Model())
    fake.AutoConfig = types.SimpleNamespace(from_pretrained=lambda name, **o: types.SimpleNamespace(max_position_embeddings=None, n_positions=12))
    torch = types.ModuleType("torch")
    for k, v in vars(TORCH).items():
        setattr(torch, k, v)
    monkeypatch.setitem(sys.modules, "transformers", fake)
    monkeypatch.setitem(sys.modules, "torch", torch)
    scorer._MODELS.clear()
    Model.calls.clear()
    yield made
    scorer._MODELS.clear()


def plain(text):
    """Costs of a text on its own, written out."""
    ids = np.array([[VOCABULARY.index(c) for c in text]])
    z = logits(ids, np.ones_like(ids))[0]
    return [None, *(math.log(sum(math.exp(v) for v in z[i - 1])) - z[i - 1][ids[0][i]] for i in range(1, len(text)))] if text else []


def frames(own, texts, size=100):
    """What the worker's function makes of a frame, without Spark."""
    import pandas as pd

    class Texts:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            self.out = pd.concat(list(run([pd.DataFrame({"text_id": [str(i) for i in range(len(texts))], "text": texts})])))
            return self

        def withColumn(self, *_):  # noqa: N802
            return self

    return own.score(Texts()).out


def test_costs_of_padded_batches(libraries, spark):
    texts = ["abc", "", "a", None, "hello there", "zz", "the end"]
    for batch in (1, 3, 8):
        Model.calls.clear()
        out = frames(scorer.TransformerScorer("some/model", batch_size=batch), texts)
        for i, t in enumerate(texts):
            own = out[out["text_id"] == str(i)]
            assert own["token"].tolist() == list(t or "") and own["char_start"].tolist() == list(range(len(t or "")))
            assert [None if v is None or math.isnan(v) else v for v in own["nll"].tolist()] == [v if v is None else pytest.approx(v, abs=1e-5) for v in plain(t or "")]
        assert max(rows for rows, _ in Model.calls) <= batch and (batch == 1 or len(Model.calls) == math.ceil(len(texts) / batch))


def test_texts_are_cut(libraries, spark):
    out = frames(scorer.TransformerScorer("some/model", max_length=4), ["abcdefgh", "ab"])
    assert out.groupby("text_id").size().tolist() == [4, 2]


def test_model_is_loaded_once_with_its_options(libraries, spark):
    own = scorer.TransformerScorer("some/model", dtype="bf16", device_map=None, trust_remote_code=True, cache_dir="/x")
    frames(own, ["ab"])
    frames(own, ["cd"])
    assert libraries == [("some/model", {"torch_dtype": "bf", "device_map": None, "trust_remote_code": True, "cache_dir": "/x"})]


def test_slow_tokenizers_are_refused(libraries, spark, monkeypatch):
    monkeypatch.setattr(Tokenizer, "is_fast", False)
    with pytest.raises(ValueError, match="fast tokenizer"):
        frames(scorer.TransformerScorer("some/model"), ["ab"])


class Limited(scorer.BigramScorer):
    def limit(self):
        return 3


def test_limit_of_the_model(libraries, spark):
    """Texts longer than the model can take have a reason, without an option that says so."""
    assert scorer.TransformerScorer("some/model").limit() == 12
    rows = spark.createDataFrame([(1, "a b", "b", "c"), (2, "a d a d b", "b", "c")], "row_idx long, clean_sentence string, target_clean string, substitute string")
    corpus = spark.createDataFrame([("a b c d",)], "text string")
    got = {r["row_idx"]: r["reason"] for r in pairs.word_scores(rows, Limited(corpus)).collect()}
    assert got == {1: None, 2: "orig_too_long"}
    got = {r["row_idx"]: r["reason"] for r in pairs.word_scores(rows, Limited(corpus), max_tokens=100).collect()}
    assert got == {1: None, 2: None}


def test_small_and_large_bigram_models_agree(spark, monkeypatch):
    """Costs are the same whether the model is broadcast or its pairs are looked up."""
    texts = spark.createDataFrame([("1", "a b a b c"), ("2", ""), ("3", None), ("4", "z a"), ("5", "c")], "text_id string, text string")
    corpus = spark.createDataFrame([("a b c a b",), ("b a",), (None,)], "text string")
    out = []
    for most in (scorer.BROADCAST, 0):
        monkeypatch.setattr(scorer, "BROADCAST", most)
        own = scorer.BigramScorer(corpus)
        assert own.small() == (most > 0)
        out.append(sorted(str(tuple(r)) for r in own.score(texts).collect()))
    assert out[0] == out[1] and len(out[0]) == 9 + 3 + 1
