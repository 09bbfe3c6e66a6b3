"""A tiny transformer stand-in: labels, truncation, padding and batches of the ONNX scorer."""

import json

import numpy as np
import pytest

pytest.importorskip("onnxruntime")
tokenizers = pytest.importorskip("tokenizers")

from quillpanel.operators import scoring  # noqa: E402

WORDS = ["[PAD]", "[UNK]", "gain", "loss", "flat", "filler"]
#: A word's logits, in the order of the outputs: positive, negative, neutral.
LOGITS = np.array([[9, 9, 9], [0, 0, 0], [2, 0, 0], [0, 2, 0], [0, 0, 2], [0, 0, 0]], np.float32)


def _field(number, value):
    """A field of a protocol buffer: a number, or bytes with their length."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _node(op, inputs, output, **ints):
    kinds = b"".join(_field(5, _field(1, k) + (_field(8, v[0]) + _field(20, 7) if isinstance(v, list) else _field(3, v) + _field(20, 2))) for k, v in ints.items())
    return _field(1, b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(4, op) + kinds)


def _value(number, name, kind, dims):
    return _field(number, _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, b"".join(_field(1, _field(2, d)) for d in dims)))))


def _model():
    """Sum of the words' logits over the places that the mask keeps."""
    table = _field(5, _field(1, LOGITS.shape[0]) + _field(1, LOGITS.shape[1]) + _field(2, 1) + _field(8, "table") + _field(9, LOGITS.tobytes()))
    graph = (
        _node("Gather", ["table", "input_ids"], "each") + _node("Cast", ["attention_mask"], "kept", to=1) + _node("Unsqueeze", ["kept"], "wide", axes=[2])
        + _node("Mul", ["each", "wide"], "masked") + _node("ReduceSum", ["masked"], "logits", axes=[1], keepdims=0)
        + _field(2, "g") + table + _value(11, "input_ids", 7, "bs") + _value(11, "attention_mask", 7, "bs") + _value(12, "logits", 1, "bc")
    )
    return _field(1, 6) + _field(8, _field(1, "") + _field(2, 11)) + _field(7, graph)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("model")
    (path / "model.onnx").write_bytes(_model())
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: i for i, w in enumerate(WORDS)}, unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.save(str(path / "tokenizer.json"))
    (path / "config.json").write_text(json.dumps({"id2label": {"0": "Positive", "1": "Negative", "2": "Neutral"}}))
    return str(path)


def _softmax(v):
    e = np.exp(np.array(v, float))
    return e / e.sum()


def test_labels_come_from_the_configuration(folder):
    (p,) = scoring.transformer_scorer(folder)()(["gain"])
    pos, neg, neu = _softmax([2, 0, 0])
    assert p == pytest.approx((neg, neu, pos), abs=1e-6)


def test_padding_changes_nothing_and_long_texts_are_truncated(folder):
    score = scoring.transformer_scorer(folder, max_length=4)()
    alone, beside = score(["loss"])[0], score(["loss", "filler filler filler filler gain"])
    assert beside[0] == pytest.approx(alone, abs=1e-6)
    assert beside[1] == pytest.approx((1 / 3, 1 / 3, 1 / 3), abs=1e-6)  # the fifth word is cut off


@pytest.mark.parametrize("batch", [1, 3, 64])
def test_rows_are_scored_the_same_in_any_batch(spark, folder, batch):
    texts = ["gain", "loss loss", "flat", "", None, "gain loss filler", "unknown words here"]
    rows = spark.createDataFrame([(f"h{k}", t) for k, t in enumerate(texts)], "headline_uid string, title string")
    got = {r["headline_uid"]: r for r in scoring.score(rows, "m", scoring.transformer_scorer(folder), batch=batch).collect()}
    assert [got[f"h{k}"]["label"] for k in range(7)] == ["pos", "neg", "neu", "neu", "neu", "neu", "neu"]
    neg, pos = _softmax([0, 4, 0])[1], _softmax([0, 4, 0])[0]
    assert got["h1"]["p_neg"] == pytest.approx(neg, abs=1e-6) and got["h1"]["score"] == pytest.approx(pos - neg, abs=1e-6)
