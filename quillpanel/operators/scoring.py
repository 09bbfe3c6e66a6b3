"""Texts scored by a pluggable model, in Arrow batches of texts of like length."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.functions.numbers import score_label


class Scorer(Protocol):
    """Texts to ``(p_neg, p_neu, p_pos)``, one triple a text."""

    def __call__(self, texts: Sequence[str]) -> Sequence[tuple[float, float, float]]: ...


class LexiconScorer:
    """A deterministic scorer that needs no model files: counts of words with a tone, through a softmax.

    It stands where a transformer would; its values are its own.
    """

    UP = frozenset("beat beats gain gains growth higher jump jumps profit raise raises record rise rises strong surge top tops up upbeat upgrade wins".split())
    DOWN = frozenset("cautious cut cuts delay delayed drop drops fall falls fraud loss lower miss misses muted probe recall recalls slump soft sued weak warns".split())

    def __call__(self, texts: Sequence[str]) -> list[tuple[float, float, float]]:
        import math

        out = []
        for t in texts:
            words = re.findall(r"[^\W\d_]+", (t or "").lower())
            up, down = sum(w in self.UP for w in words), sum(w in self.DOWN for w in words)
            e = [math.exp(down), math.e, math.exp(up)]
            s = sum(e)
            out.append((e[0] / s, e[1] / s, e[2] / s))
        return out


def transformer_scorer(path: str, max_length: int = 64) -> Callable[[], Scorer]:
    """A scorer over an ONNX classifier and its tokenizer in ``path`` (files ``model.onnx``, ``tokenizer.json``, ``config.json``).

    The label of each output is read from the configuration, never assumed.
    """
    def load() -> Scorer:
        import json

        import numpy as np
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(f"{path}/model.onnx")
        tokenizer = Tokenizer.from_file(f"{path}/tokenizer.json")
        tokenizer.enable_truncation(max_length)
        tokenizer.enable_padding()
        with open(f"{path}/config.json") as f:
            names = {k: v.lower() for k, v in json.load(f)["id2label"].items()}
        at = [next(int(k) for k, v in names.items() if v.startswith(p)) for p in ("neg", "neu", "pos")]
        inputs = {i.name for i in session.get_inputs()}

        def score(texts: Sequence[str]):
            enc = tokenizer.encode_batch(list(texts))
            feed = {"input_ids": [e.ids for e in enc], "attention_mask": [e.attention_mask for e in enc], "token_type_ids": [e.type_ids for e in enc]}
            logits = session.run(None, {k: np.array(v, np.int64) for k, v in feed.items() if k in inputs})[0].astype(np.float32)
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            return [tuple(float(r[i]) for i in at) for r in p]

        return score

    return load


def score(rows: DataFrame, model: str, make: Callable[[], Scorer] = LexiconScorer, ident: str = "headline_uid", text: str = "title", batch: int = 64) -> DataFrame:
    """``(ident, model, p_neg, p_neu, p_pos, score, label)`` of each row.

    The scorer is made once per task. Texts are sorted by length within a
    partition, so a batch pads little.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for f in frames:
            texts = f["text"].fillna("").tolist()
            p = [t for k in range(0, len(texts), batch) for t in scorer(texts[k : k + batch])]
            yield pd.DataFrame({"id": f["id"].to_numpy(), "p_neg": [x[0] for x in p], "p_neu": [x[1] for x in p], "p_pos": [x[2] for x in p]})

    sorted_ = rows.select(F.col(ident).alias("id"), F.col(text).alias("text")).sortWithinPartitions(F.length("text"))
    out = sorted_.mapInPandas(run, "id string, p_neg double, p_neu double, p_pos double").withColumn("score", F.col("p_pos") - F.col("p_neg"))
    return out.select(F.col("id").alias(ident), F.lit(model).alias("model"), "p_neg", "p_neu", "p_pos", "score", score_label(F.col("score")).alias("label"))
