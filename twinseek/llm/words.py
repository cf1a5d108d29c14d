"""Words of ASCII-folded texts as bytes, and column picking, shared by operators of this package."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Text bytes that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 4 << 20
# Words are runs of [0-9a-z] and of all characters beyond ASCII once A-Z are lower-cased; everything else separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; null has none."""
    return text.translate(_FOLD).split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow column of strings."""
    return column.cast(pa.binary()).to_pylist()


def slices(texts: Sequence[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of `texts` with at most `limit` bytes each, or one text."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or b"")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns (`new=old`) and no others, whatever other columns there are.

    The exact name is taken, else the only one that is equal but for case.
    """
    places = {}
    for new, old in columns.items():
        exact = [i for i, c in enumerate(df.columns) if c == old]
        near = exact or [i for i, c in enumerate(df.columns) if c.lower() == old.lower()]
        if len(near) != 1:
            raise ValueError(f"{len(near)} columns are called {old!r}; there are {', '.join(df.columns)}")
        places[new] = near[0]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in places.items()])


def ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers start, start + 1 ... of `counts` each, and the row each belongs to."""
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(len(owner)) - before[owner] + starts[owner], owner
