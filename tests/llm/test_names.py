"""Columns whose names clash with those an operator uses or makes, and conversations whose fields hold separators."""

from __future__ import annotations

import public_tokenizers
import pytest

from twinseek.llm import byte_bpe, chat_format, language_id, quality_classifier

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, _text string, _in string, IDS string, Lang_Pred string, X string, last string, c0 string, `a.b` int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "plain words here", "p", "q", "r", "s", "t", "u", "v", 1), (2, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_byte_bpe(docs):
    coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == [c for c in docs.columns if c != "IDS"] + ["ids"]
    back = byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: (bytes(r["decoded"]), r["_text"], r["_in"], r["a.b"]) for r in back} == {1: (b"plain words here", "p", "q", 1), 2: (b"", None, None, None)}
    both = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, ids=True)
    assert "IDS" not in both.columns and "text" not in both.columns
    assert {r["doc_id"]: (r["n_tokens"] > 0, r["last"], r["c0"]) for r in both.collect()} == {1: (True, "u", "v"), 2: (False, None, None)}


def test_language_id(docs):
    model = language_id.fit(["plain words here"] * 20 + ["ganz andere dinge"] * 20, ["en"] * 20 + ["de"] * 20)
    found = language_id.predict(docs, model)
    assert "Lang_Pred" not in found.columns
    assert {r["doc_id"]: (r["lang_pred"], r["_text"]) for r in found.collect()} == {1: ("en", "p"), 2: ("und", None)}


def test_statistics(docs):
    found = quality_classifier.with_statistics(docs)
    assert found.columns == [c for c in docs.columns if c not in ("text", "X")] + ["x"]
    assert [r["_text"] for r in found.orderBy("doc_id").collect()] == ["p", None]


def test_conversations_with_separators_stay_apart(spark):
    turns = [(1, 0, "a", "b\x1fc"), (2, 0, "a\x1fb", "c"), (3, 0, "a:", "b"), (4, 0, "a", ":b"), (5, 0, "a", "b\x1fc")]
    out = chat_format.chat_examples(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()
    assert {r["conv_id"]: r["copies"] for r in out} == {1: 2, 2: 1, 3: 1, 4: 1}
