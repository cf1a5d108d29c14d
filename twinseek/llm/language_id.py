"""Language identification: averaged hashed subword embeddings with a linear softmax.

Training runs in numpy on the driver, on a bounded sample (`SAMPLE_PER_LANG` whole documents of each language, chosen by
a hash of the id). A document is the average of the embeddings of its hashed byte n-grams; stochastic gradient descent
fits embeddings and softmax together. Part of the sample is kept out of the fit to calibrate a temperature and the score
below which a prediction is rejected.

Prediction covers whole texts in Arrow batches: since the model is linear in the average, embeddings times weights
collapse to one small table of logits per bucket, which is all that is shipped (BUCKETS x languages floats).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from twinseek.llm.common import arrow_map, column_last, held_out

BUCKETS = 1 << 15
DIM = 16
GRAMS = (3, 4)
# Bound of the training sample: whole documents per language.
SAMPLE_PER_LANG = 500
STEPS = 1500
BATCH = 32
RATE = 20.0
# Share of the sample kept for calibration, and share of it that may fall under the rejection score.
CALIBRATION = 0.2
REJECTED_SHARE = 0.002
# A rejection score is never above this: a prediction more likely than all others together is not rejected.
REJECT_AT_MOST = 0.5
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_PAD = b" " * max(GRAMS)
# ASCII letters are kept, all other ASCII becomes a space; bytes of other characters are kept as they are.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _folded(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()) + _PAD


def buckets(stream: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte; the stream ends with padding."""
    n = len(stream) - max(GRAMS) + 1
    h = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(size):
        h = (h ^ stream[i : i + n]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - int(np.log2(BUCKETS)))


@dataclass
class LanguageModel:
    """Logits per bucket, one bias per language, the calibrated temperature and the rejection score."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row per text, of at least one byte."""
        out = np.zeros((len(texts), len(self.langs)))
        group: list[int] = []
        size = 0
        parts: list[bytes] = []

        def flush() -> None:
            if not group:
                return
            lengths = np.array([len(p) - len(_PAD) for p in parts])
            stream = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
            starts = np.concatenate(([0], np.cumsum(lengths + len(_PAD))[:-1]))
            cuts = np.stack([starts, starts + lengths], axis=1).ravel()  # the text, then its padding
            total = np.zeros((len(group), len(self.langs)))
            for n in GRAMS:
                found = self.table[np.concatenate((buckets(stream, n), np.zeros(max(GRAMS) - 1, np.uint32)))]
                total += np.add.reduceat(found, cuts, axis=0, dtype=np.float64)[::2]
            out[group] = total / (len(GRAMS) * lengths)[:, None] + self.bias
            group.clear()
            parts.clear()

        for i, text in enumerate(texts):
            group.append(i)
            parts.append(_folded(text))
            size += len(parts[-1])
            if size > 1 << 20:
                flush()
                size = 0
        flush()
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _softmax(self.logits(texts) / self.temperature)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and rejection of each text; texts without a letter are 'und', score 0, rejected."""
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if known and self.langs:
            p = self.probabilities([texts[i] for i in known])
            best = p.argmax(axis=1)
            for i, k, score in zip(known, best.tolist(), p[np.arange(len(p)), best].tolist(), strict=True):
                langs[i], scores[i], rejected[i] = self.langs[k], min(1.0, score), score < self.reject_below
        return langs, scores, rejected


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 7) -> LanguageModel:
    """Trains and calibrates on the given documents; those without a letter are left out."""
    rows = [(t, lang) for t, lang in zip(texts, langs, strict=True) if has_letter(t)]
    names = sorted({lang for _, lang in rows})
    if len(names) < 2:
        return LanguageModel(names, np.zeros((BUCKETS, len(names)), np.float32), np.zeros(len(names)))
    rng = np.random.default_rng(seed)
    target = np.array([names.index(lang) for _, lang in rows])
    features = []
    for text, _ in rows:
        stream = np.frombuffer(_folded(text), np.uint8).astype(np.uint32)
        found = np.concatenate([buckets(stream, n)[: len(stream) - len(_PAD)] for n in GRAMS])
        ids, counts = np.unique(found, return_counts=True)
        features.append((ids.astype(np.int64), (counts / len(found)).astype(np.float32)))
    order = rng.permutation(len(rows))
    kept_out = order[: int(len(rows) * CALIBRATION)]
    train = order[len(kept_out) :]
    embedding = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights = rng.normal(0, 1 / DIM, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    step = 0
    while step < STEPS:
        rng.shuffle(train)
        for at in range(0, min(len(train), (STEPS - step) * BATCH), BATCH):
            part = train[at : at + BATCH]
            rate = RATE * (1 - step / STEPS)
            step += 1
            hidden = np.stack([features[i][1] @ embedding[features[i][0]] for i in part])
            error = _softmax((hidden @ weights + bias).astype(np.float64)).astype(np.float32)
            error[np.arange(len(part)), target[part]] -= 1
            error /= len(part)
            back = error @ weights.T
            weights -= rate * 0.05 * hidden.T @ error
            bias -= rate * 0.005 * error.sum(axis=0)
            for row, i in enumerate(part):
                ids, share = features[i]
                embedding[ids] -= rate * share[:, None] * back[row]
    model = LanguageModel(names, (embedding @ weights).astype(np.float32), bias.astype(np.float64))
    if len(kept_out):
        raw = model.logits([rows[i][0] for i in kept_out])
        truth = target[kept_out]
        losses = {
            t: -np.log(_softmax(raw / t)[np.arange(len(raw)), truth] + 1e-12).mean() for t in np.geomspace(0.02, 20, 61)
        }
        model.temperature = float(min(losses, key=losses.get))
        scores = _softmax(raw / model.temperature).max(axis=1)
        model.reject_below = float(min(REJECT_AT_MOST, np.quantile(scores, REJECTED_SHARE)))
    return model


def training_sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """(lang, text): at most `per_lang` documents of each language, the same ones each time.

    Only documents whose crc32(doc_id as text) mod 3 is not 1, with text and language, are taken. Counts per language set
    a hash threshold first, so that the ranking handles about twice the sample, not the table.
    """
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    share = (F.lit(2.0 * per_lang) / F.col("n")) * 2.0**64 - 2.0**63
    near = usable.select("lang", "text", draw.alias("draw")).join(F.broadcast(counts), "lang").filter(F.col("draw") <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))
    return near.withColumn("rank", rank).filter(F.col("rank") <= per_lang).select("lang", "text")


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Model from the columns doc_id, text and lang; the sample it collects is bounded by `per_lang` whole texts a language."""
    rows = training_sample(docs.select("doc_id", "lang", "text"), per_lang).collect()
    rows.sort(key=lambda r: (r.lang, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """`docs` without its text column, with lang_pred, score and rejected; columns of these names, in any case, are replaced.

    Null texts and texts without a letter get 'und' and score 0 and are rejected. Only the text is an input of a prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    outs = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    source, kept = column_last(docs, text, [o.name for o in outs], drop=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column(len(kept)).to_pylist())
            cols = [pa.array(x, k) for x, k in zip(found, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[o.name for o in [*kept, *outs]])

    return arrow_map(source, run, T.StructType([*kept, *outs]))


def not_rejected(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns unchanged, whose language is predicted with enough confidence."""
    row: Column = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    return predict(packed, model).filter("NOT rejected").select("row.*")
