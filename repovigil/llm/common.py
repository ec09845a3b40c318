"""Helpers shared by the training-data operators.

Text is handled as UTF-8 bytes inside Arrow batches: ASCII case mapping and splitting then work on
whole buffers, and no text is decoded that need not be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words and is stripped from lines.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; others cannot clash."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_digest(text: Column) -> Column:
    """16 bytes that stand for a text (null as empty); equals ``hashlib.md5`` of its UTF-8 bytes."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of at most ``rows`` rows, so that what a step builds stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space."""
    return text.lower().split()


def arrow_map(
    df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    return df.mapInArrow(step, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well mixed 64-bit hash of 64-bit keys, another one for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0xD6E8FEB86659FD93
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACE, np.uint8))
#: A random value for each byte; A-Z have those of a-z.
_BYTE = mix(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64), 12345)
_PIECE = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < size:
        size = max(size, _PIECE)
        _POWERS[:] = [
            np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 2**64))
        ]
    return _POWERS[0], _POWERS[1]


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words in a buffer of bytes, all at once.

    A word's hash is a polynomial in its bytes modulo 2^64 with random byte values, read off running
    sums; it does not depend on the word's place.
    """
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True]))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start], 0), start


def word_hashes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """64-bit hashes of the words of texts: A-Z lower-cased, split at ASCII white space.

    Texts are hashed together in buffers of about 256 KB, in order: the hashes of a buffer, and where
    its texts begin and end in them. A longer text goes in pieces cut at white space, as one buffer.
    """
    pending: list[bytes] = []
    size = 0
    for text in [*texts, None]:
        if text is None or size + len(text) > _PIECE:
            if pending:
                h, start = _hash_words(np.frombuffer(b" ".join(pending), np.uint8))
                ends = np.cumsum([len(t) + 1 for t in pending])
                yield h, np.r_[0, np.searchsorted(start, ends)]
            pending, size = [], 0
        if text is None:
            return
        if len(text) <= _PIECE:
            pending.append(text)
            size += len(text) + 1
            continue
        data, parts, at = np.frombuffer(text, np.uint8), [], 0
        while at < len(data):
            stop = min(len(data), at + _PIECE)
            while stop < len(data):  # on to the next white space
                space = _IS_SPACE[data[stop : stop + _PIECE]]
                if space.any():
                    stop += int(np.argmax(space))
                    break
                stop = min(len(data), stop + _PIECE)
            parts.append(_hash_words(data[at:stop])[0])
            at = stop
        whole = np.concatenate(parts)
        yield whole, np.array([0, len(whole)])
