"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text becomes a short vector of transformed statistics (logs of counts, logits of shares). For each class the
mean and a covariance are estimated from sums that executors add up; covariances are shrunk towards the pooled one and
towards a diagonal. A document's score is the logistic of the difference of the two log densities, whose Mahalanobis
distances use Cholesky factors computed once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinseek.llm.common import arrow_map, column_last, held_out, texts_of
from twinseek.session import materialize

# Shrinkage of a class covariance towards the pooled one, and of the result towards its diagonal.
TO_POOLED = 0.1
TO_DIAGONAL = 0.05
RIDGE = 1e-3
# Statistics further than this many pooled standard deviations from the class means are pulled in: one odd statistic of a
# good document must not decide alone.
CLIP = 4.0
# Words after which the statistics of a text count half; those of shorter texts are drawn to the centre, as they are noisy.
HALF_WORDS = 15.0
# Added to shares before their logit is taken.
FLOOR = 0.005

FEATURES = (
    "words", "word_length", "word_length_spread", "upper", "digits", "stops", "symbols", "shouts", "bars", "odd_ends", "distinct", "top_word",
    "repeated_lines", "line_words", "repeated_pairs", "entropy",
)
_UPPER = re.compile(rb"[A-Z]|\xc3[\x80-\x9e]")
_SYMBOLS = np.array([ord(c) for c in "#$%&*@^~<>=_+/\\{}[]"])
_STOPS = np.array([ord(c) for c in ".,;:?"])


def _logit(part: float, whole: float) -> float:
    """Logit of a share with a floor: no occurrence means the same in short and in long texts."""
    share = part / whole if whole > 0 else 0.0
    return float(np.log((share + FLOOR) / (1 - min(share, 1.0) + FLOOR)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of FEATURES; an empty text has well-defined ones."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = int(bytes_[65:91].sum() + bytes_[97:123].sum() + bytes_[128:].sum() // 2)
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    found = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = bytes_[bytes_ > 0] / max(1, len(raw))
    ends = sum(map(raw.count, (b"!! ", b"!!\n", b"% ", b"* ", b"# ", b"& ", b"$ ", b"| ")))
    return [
        float(np.log1p(n)),
        float(np.log1p(sizes.mean())),
        float(np.log1p(sizes.std())),
        _logit(len(_UPPER.findall(raw)), letters),
        _logit(int(bytes_[48:58].sum()), len(raw)),
        _logit(int(bytes_[_STOPS].sum()), len(raw)),
        _logit(int(bytes_[_SYMBOLS].sum()), len(raw)),
        _logit(int(bytes_[33]), len(raw)),
        _logit(int(bytes_[124]), len(raw)),
        _logit(ends, n),
        float(np.log1p(len(found)) / np.log1p(max(n, 1))),
        _logit(max(found.values(), default=0), n),
        _logit(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        _logit(max(n - 1, 0) - pairs, max(n - 1, 0)),
        float(-(share * np.log2(share)).sum()) if len(share) else 0.0,
    ]


def standardised(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Centred, scaled, clipped, and drawn to the centre by how short the text is (the first statistic is log(1 + words))."""
    words = np.expm1(x[:, :1])
    return np.clip((x - centre) / scale, -CLIP, CLIP) * words / (words + HALF_WORDS)


@dataclass
class Discriminant:
    """Centre and scale of the statistics; per class the mean, inverse Cholesky factor and log prior less half log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        z = standardised(x, self.centre, self.scale)
        log = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(count: np.ndarray, total: np.ndarray, outer: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> Discriminant:
    """From per-class counts, sums and sums of outer products of the standardised, clipped statistics.

    A class without rows takes the moments of the other; without any rows all scores are one half.
    """
    d = total.shape[1]
    all_n = max(1.0, count.sum())
    mean_all = total.sum(axis=0) / all_n
    means = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], mean_all)
    scatter = [outer[c] - count[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / all_n + RIDGE * np.eye(d)
    factors, offsets = [], []
    for c in (0, 1):
        own = scatter[c] / max(1.0, count[c])
        s = (1 - TO_POOLED) * own + TO_POOLED * pooled if count[c] > 1 else pooled
        s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.diag(s)) + RIDGE * np.eye(d)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log((count[c] + 1) / (count.sum() + 2)) - np.log(np.diag(low)).sum())
    return Discriminant(centre, scale, means, np.array(factors), np.array(offsets))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, with `x`, the statistics (ARRAY<DOUBLE>) of the whole text; null counts as empty."""
    source, kept = column_last(docs, text, ["x"], drop=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in texts_of(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*[k.name for k in kept], "x"])

    schema = T.StructType([*kept, T.StructField("x", T.ArrayType(T.DoubleType()))])
    return arrow_map(source, run, schema)


def _moments(rows: DataFrame, centre: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and outer-product sums of the standardised statistics per label; each task adds up its rows first."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            labels = batch.column(0).to_numpy()
            if not len(labels):
                continue
            z = standardised(np.array(batch.column(1).to_pylist()), centre, scale)
            for c in (0, 1):
                own = z[labels == c]
                sums[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["label", "sums"])

    parts = arrow_map(rows.select(F.col("label").cast("int"), "x"), run, "label int, sums array<double>")
    added = parts.select("label", F.posexplode("sums").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((2, 1 + d + d * d))
    for r in added:  # 2 x (1 + d + d * d) numbers, whatever the input
        out[r.label, r.i] = r.v
    return out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(2, d, d)


def train(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> Discriminant:
    """From documents with statistics (`x`) and a table (doc_id, quality); held-out ids (crc32 mod 3 is 1) are not used.

    Labels other than 0 and 1 are ignored. All labelled rows are used; only sums reach the driver.
    """
    wanted = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label")).filter("label IN (0, 1)")
    rows = measured.select(F.col(f"`{doc_id}`").alias("_id"), "x").filter(~held_out(F.col("_id"))).join(wanted, "_id").select("label", "x")
    d = len(FEATURES)
    spread = [f for i in range(d) for f in (F.avg(F.col("x")[i]).alias(f"m{i}"), F.stddev_pop(F.col("x")[i]).alias(f"s{i}"))]
    stats = rows.agg(*spread).first()
    centre = np.array([stats[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([max(stats[f"s{i}"] or 1.0, 1e-3) for i in range(d)])
    return fit(*_moments(rows, centre, scale), centre, scale)


def score(measured: DataFrame, model: Discriminant) -> DataFrame:
    """`measured` with score (probability of class 1) and predicted (1 if score >= 0.5) in place of its statistics."""
    shared = measured.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in measured.columns if c not in ("x", "score", "predicted")]
    source = measured.select(*[F.col(f"`{c}`") for c in kept], "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(len(kept)).to_pylist()
            found = shared.value.scores(np.array(rows).reshape(len(rows), len(FEATURES)))
            cols = [pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*kept, "score", "predicted"])

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return arrow_map(source, run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Trains on `labels` and scores every whole text of `docs`.

    Only the text is an input of a score. Null and empty texts are scored like any other; repeated rows give repeated rows.
    """
    measured = materialize(with_statistics(docs.select("doc_id", "text")), "quality-statistics")
    scored = score(measured, train(measured, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
