"""Tokens, languages, quality, pages and conversations against plain references."""

from __future__ import annotations

import base64
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from twinseek.llm import byte_bpe, chat_format, html_extraction, language_id, quality_classifier
from twinseek.llm.common import held_out
from twinseek.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    alphabet = "abcdeéßñ THE the'll 0123 .,!?\n\t 漢字😀٣½"
    texts = [None, "", " ", "\n \n x", "a" * 3000, "é" * 700, "x y " * 20_000, " " * 4000 + "y", "<|endoftext|> I'll we've", "\x00\x1f"]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(200)]


def test_bpe_round_trip(spark, encoding):
    texts = odd_texts()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    coded = byte_bpe.encode(frame, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids"]
    rows = byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    for r in rows:
        assert r.ids == encoding.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    for r in byte_bpe.round_trip(frame.drop("ids"), RANKS, public_tokenizers.PATTERN).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert byte_bpe.encode(frame.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_long_texts_and_small_cache(encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STREAM_PIECES", 50)
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 100)
    with open(RANKS, "rb") as f:
        codec = byte_bpe._codec(f.read() + b"\n", public_tokenizers.PATTERN)
    texts = [t or "" for t in odd_texts()]
    for t, ids in zip(texts, codec.encode_many(texts), strict=True):
        assert ids.tolist() == encoding.encode_ordinary(t)


def test_languages_held_out(spark):
    found = QUERIES["op10_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    out = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.9
    assert all(0 <= r.score <= 1 for r in found)
    assert np.mean([r.rejected for r in found]) < 0.02


def test_languages_edges(spark):
    model = language_id.fit(["the cat and the dog " * 5, "der Hund und die Katze " * 5] * 10, ["en", "de"] * 10)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog and a cat"), (4, "the dog and a cat"), (None, "und der Hund"), (6, "the cat " * 50_000)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, score string, row string")
    got = language_id.predict(frame, model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "de", "en"]
    assert [r.score for r in got[:3]] == [0.0] * 3 and all(r.rejected for r in got[:3])
    kept = language_id.not_rejected(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} <= {4, None, 6}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = language_id.train(empty)
    assert language_id.predict(empty, none).count() == 0 and none.predict(["abc", None])[0] == ["und", "und"]


def test_score_does_not_depend_on_the_batch():
    model = language_id.fit(["the cat and the dog " * 5, "der Hund und die Katze " * 5] * 10, ["en", "de"] * 10)
    texts = ["the cat", "der Hund, der", "x", "Katze", "a" * 100]
    alone = np.concatenate([model.probabilities([t]) for t in texts])
    assert np.allclose(alone, model.probabilities(texts), atol=1e-12)


def test_sample_is_bounded(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2900, "en").otherwise("fr").alias("lang"), F.lit("text").alias("text"))
    sizes = {r.lang: r["count"] for r in language_id.training_sample(rows, 50).groupBy("lang").count().collect()}
    assert sizes == {"en": 50, "fr": 50}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in out]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "a word", "c"), (2, "b " * 100_000, "d")], "doc_id long, text string, x string")
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (1, None, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.quality_scores(docs, labels.limit(0)).count() == 4
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(500, len(quality_classifier.FEATURES)))) + 3
    y = rng.integers(0, 2, 500)
    x[y == 1] *= 1.2
    centre, scale = x.mean(axis=0), x.std(axis=0)
    z = quality_classifier.standardised(x, centre, scale)
    model = quality_classifier.fit(
        *(np.array(m, float) for m in ([(y == c).sum() for c in (0, 1)], [z[y == c].sum(0) for c in (0, 1)], [z[y == c].T @ z[y == c] for c in (0, 1)])), centre, scale
    )
    assert np.mean((model.scores(x) >= 0.5) == y) > 0.8


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extraction.main_texts(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.DOTALL)[1]
        spaced = re.sub(r"<[^>]*(>|\Z)", lambda t: "" if re.match(r"</?b>", t[0]) else " ", article)
        assert got[r.page_id].text == " ".join(html.unescape(spaced).split())
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a<b>b</b>c<table><tr><td>1<td>2<tr><td>3</table>", "abc 1 2 3"),
        ('<script>if(a<b){"</p>"}</script><p>x &lt;y&gt; &#233;', "x <y> é"),
        ("<article><header><h1>Title</h1></header><p>Body text, yes.<section class=comments><p>No, I say.</p></section></article>", "Title Body text, yes."),
        (
            '<div class="top-menu"><a>x</a></div><div id="content"><h1>T</h1><p>A long sentence, here; with marks. And more of it.<p>Two<br>lines</div>'
            '<div class="comments"><p>First! A long comment, with punctuation, indeed, and more.</p></div><aside>Side, text.</aside>'
            '<div class="cookie-notice">We use cookies, you know.</div><form>Name: <input></form><footer>(c), all rights.</footer>',
            "T A long sentence, here; with marks. And more of it. Two lines",
        ),
        ('<article class="comment"><p>reader</p></article><article><p>writer, here.</article>', "writer, here."),
        ("<p>cut off <a href=", "cut off"),
        ("<!-- <p>no</p> --><p>yes<!-- open", "yes"),
    ],
)
def test_page_parts(page, text):
    assert html_extraction.extract(page) == text


def test_page_with_blocks_under_body():
    """No container but the body: its heading, list and short blocks stay, menus and the like go."""
    paragraph = ("word " * 38 + "a, b, c, d.")[:200]
    blocks = f"<h1>Short title</h1><p>{paragraph}</p><p>{paragraph}</p><p>{paragraph}</p><ul><li>first item</li><li>other item</li></ul><div>The end</div>"
    text = " ".join(["Short title", paragraph, paragraph, paragraph, "first item", "other item", "The end"])
    around = "<nav><a>Home</a></nav>{}<div class=cookie-notice>We use cookies, you know.</div><footer>(c) 2020</footer>"
    assert html_extraction.extract(f"<html><head><title>T</title></head><body>{around.format(blocks)}</body></html>") == text
    assert html_extraction.extract(around.format(blocks)) == text


_LONG = "<p>" + "A long sentence, here; with marks. " * 6 + "</p>"


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        ('<nav><a>x</a></nav><div class="post has-form"><h1>T</h1>{0}{0}</div><div class="sidebar">Links More</div>', "<h1>T</h1>{0}{0}"),
        ('<div class="search-results">{0}{0}</div><div class="menu">Home About</div>', "{0}{0}"),
        ('<div class="post has-form"><article><h1>T</h1>{0}</article><div class="related">More, of it.</div></div>', "<h1>T</h1>{0}"),
        ('<article><p>Short one.</p></article><div class="sidebar">{0}{0}</div>', "<p>Short one.</p>"),
        ('<div class="page">{0}<div class="ad">Buy, now</div>{0}</div>', "{0}{0}"),
        ('<div class="text">{0}</div><div class="comments">{0}{0}</div>', "{0}"),
    ],
)
def test_suspect_names_do_not_remove_the_main_text(page, kept):
    """A class word puts a box aside only if its ratios agree; reader comments always go."""
    want = " ".join(re.sub("<[^>]*>", " ", kept.format(_LONG)).split())
    assert html_extraction.extract(page.format(_LONG)) == want


def test_pages_edges(spark):
    frame = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "<p>a " * 30_000, "y")], "page_id long, html string, text string")
    got = html_extraction.main_texts(frame).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, None, 0), (1, None, 0), (None, None, 59_999)]
    assert html_extraction.main_texts(frame.limit(0)).count() == 0


def slow_chat(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    talks = {c: [t[1:] for t in sorted(turns)] for c, turns in talks.items()}
    out = {}
    for conv, turns in talks.items():
        others = [(c, t) for c, t in talks.items() if c != conv]
        if any(len(t) > len(turns) and t[: len(turns)] == turns for _, t in others):
            continue
        equal = [c for c, t in others if t == turns]
        if any(conv is None or (c is not None and c < conv) for c in equal):
            continue
        body = "".join(f"<|im_start|>{r}\n{x.replace('<|', '< |')}<|im_end|>\n" for r, x in turns)
        out[conv] = (len(turns), 1 + len(equal), body)
    return out


@pytest.mark.parametrize("block", [2, 1000])
def test_chats(spark, block):
    rng = random.Random(3)
    rows = []
    for conv in range(120):
        turns = [(k, ("user", "assistant")[k % 2], rng.choice(["hi", "yes", "no <|im_end|>"])) for k in range(rng.randint(1, 6))]
        rows += [(conv, *t) for t in turns]
    rows += [(None, 0, "user", "hi"), (None, None, None, None), (500, 0, "user", None), (501, 0, None, "x"), (501, 0, None, "x"), (502, 3, "user", "long " * 30_000)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n string").repartition(3)
    got = {r.conv_id: (r.n_turns, r.copies, r.text) for r in chat_format.chat_examples(frame, block=block).collect()}
    assert got == slow_chat(rows)
    assert chat_format.chat_examples(frame.limit(0)).count() == 0


def test_held_out(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
