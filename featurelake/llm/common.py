"""Small helpers that several operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import featurelake

_SHIPPED: set[str] = set()
#: Words of the contracts: runs of anything but blank and tab to carriage return. ``bytes.split`` cuts alike.
WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on this machine; ``TOKENIZER_DIR`` overrides the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def partitions(df: DataFrame) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def crc_part(column: str, parts: int) -> Column:
    """crc32 of a number written as text, modulo ``parts``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def hashable(df: DataFrame) -> list[str]:
    """Columns that xxhash64 takes: those without a map or variant inside."""
    return [f"`{f.name}`" for f in df.schema if not re.search(r"\b(map|variant)\b", f.dataType.simpleString())]


def ship(df: DataFrame) -> DataFrame:
    """Give the executors this package, as ``--py-files`` would, once per Spark context.

    The archive is made where the driver runs and handed out by Spark's own file server.
    """
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(featurelake.__file__).parent
        archive = Path(tempfile.mkdtemp()) / f"featurelake-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)
    return df


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """Apply a function from one Arrow batch to dictionaries of equally long columns."""
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) for f in kinds], schema=kinds)

    return ship(df).mapInArrow(run, target)


def as_array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to about ``limit``; a larger row stands alone."""
    start = total = i = 0
    for i, size in enumerate(sizes, 1):
        if total and total + size > limit:
            yield start, i - 1
            start, total = i - 1, 0
        total += size
    if i > start:
        yield start, i


def binary_sizes(values: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.binary_length(values).to_pylist()


# -- hashing of words and shingles ------------------------------------------------------------------

_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_PLACE = _RANDOM.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and for each text the number of words before it (one more at the end).

    A word's polynomial hash is cut out of one running sum over all bytes, so no word becomes an object.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ink = ~_BLANK[data]
    edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
    if ink[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, and the bounds of the texts among them.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(bounds[:-1] - out[:-1], made) + np.arange(out[-1])
    width = np.repeat(np.minimum(counts, n), made)
    h = np.zeros(out[-1], np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        part = padded[first + k] * _PLACE[k]
        h += part if (counts >= n).all() else np.where(width > k, part, np.uint64(0))
    return mixed(h + width.astype(np.uint64)), out
