"""Line dedup: lines that many documents share are dropped from all of them.

1. One pass over the texts gives narrow rows (line hash, text digest, copies); equal texts that one
   task meets are one row with a number of copies, so a large group of copies stays small.
2. The hashes of all distinct lines are dealt into shards of bounded size. Each shard is a minimal
   perfect hash with a fingerprint and a count array (``mphf``), stored as one binary value.
3. The line hashes of the documents are dealt to the same shards, large shards in several parts. A
   task reads its shard's arrays and then streams hashes past them: no line meets another line, and
   a very frequent line is spread over many tasks.
4. What was found frequent is gathered per text and sent back to the documents.

A line is known by a 64-bit hash of its key. Among n distinct lines about n^2 / 2^65 pairs share a
hash; the counts of such a pair are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repovigil.llm.common import SPACE, as_bytes, id_text, shuffle_partitions, slices, text_digest
from repovigil.llm.mphf import CountIndex
from repovigil.session import written

MIN_DOCS = 10
MIN_CHARS = 1
SHARD_KEYS = 500_000


def _key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def line_hashes(lines: list[bytes], min_chars: int) -> list[int | None]:
    """A signed 64-bit hash of each line's key; None for keys that are too short."""
    keys = map(_key, lines)
    return [
        xxhash.xxh3_64_intdigest(k) - (1 << 63) if _long_enough(k, min_chars) else None for k in keys
    ]


def _occurrences(min_chars: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000):
            copies: dict[bytes, int] = {}
            texts: dict[bytes, bytes] = {}
            for text in as_bytes(batch.column(1)):
                d = hashlib.md5(text).digest()
                copies[d] = copies.get(d, 0) + 1
                texts.setdefault(d, text)
            hashes, digests, counts = [], [], []
            for d, text in texts.items():
                own = {h for h in line_hashes(text.split(b"\n"), min_chars) if h is not None}
                hashes += own
                digests += [d] * len(own)
                counts += [copies[d]] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(digests, pa.binary()), pa.array(counts, pa.int64())],
                ["line", "digest", "copies"],
            )

    return step


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, line, docs) sorted by shard: one index for each shard, one shard at a time."""

    def index(shard, keys, counts):
        data = CountIndex.build(np.concatenate(keys), np.concatenate(counts)).dumps()
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([data], pa.binary())], ["shard", "arrays"]
        )

    now, keys, counts = None, [], []
    for batch in batches:
        shard, line, docs = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if now is not None and shard[a] != now:
                yield index(now, keys, counts)
                keys, counts = [], []
            now = int(shard[a])
            keys.append(line[a:b].view(np.uint64))
            counts.append(docs[a:b])
    if now is not None:
        yield index(now, keys, counts)


def _probe(min_docs: int):
    """Rows sorted by (shard, part, kind): the arrays of a shard, then hashes that are looked up."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in slices(batches, 100_000):
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            line = batch.column(1)
            heads = np.flatnonzero(kind == 0)
            cuts = [0, *heads, len(kind)]
            frequent = np.zeros(len(kind), bool)
            for a, b in zip(cuts, cuts[1:]):
                if a < b and kind[a] == 0:
                    index = CountIndex.loads(batch.column(3)[int(a)].as_py())
                    a += 1
                if a < b:
                    keys = line.slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    frequent[a:b] = index.lookup(keys) >= min_docs
            rows = pa.array(np.flatnonzero(frequent))
            yield pa.RecordBatch.from_arrays([batch.column(2).take(rows), line.take(rows)], ["digest", "line"])

    return step


def _shard_of(shards: int):
    # not the partitioner's hash, and not one that the index uses
    return F.pmod(F.xxhash64(F.col("line"), F.lit("shard")), F.lit(shards)).cast("int")


def frequent_lines(
    docs: DataFrame, min_docs: int, min_chars: int, count_copies: bool = True, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """(digest, lines array<long>): the frequent lines of each distinct text that has any."""
    spark = docs.sparkSession
    found = docs.mapInArrow(_occurrences(min_chars), "line long, digest binary, copies long")
    if not count_copies:
        found = found.select("line", "digest").distinct().withColumn("copies", F.lit(1).cast("bigint"))
    found = written(found, "lines")
    counts = written(found.groupBy("line").agg(F.sum("copies").alias("docs")), "line-counts")
    shards = max(shuffle_partitions(spark), -(-counts.count() // shard_keys))
    arrays = written(
        counts.select(_shard_of(shards).alias("shard"), "line", "docs")
        .repartition(shards, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_build, "shard int, arrays binary"),
        "line-index",
    )
    # texts are distinct here but for copies that different tasks met
    probes = found.select(_shard_of(shards).alias("shard"), "line", "digest")
    # a shard with a very frequent line gets several parts, of twice the rows of a usual shard at most
    usual = max(1, 2 * found.count() // shards)
    parts = probes.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(usual)).cast("int").alias("parts"))
    parts = F.broadcast(parts)  # one row a shard
    heads = arrays.join(parts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"),
        F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("binary").alias("digest"), "arrays",
    )
    tails = probes.join(parts, "shard").select(
        "shard", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"),
        "line", "digest", F.lit(None).cast("binary").alias("arrays"),
    )
    return (
        heads.unionByName(tails)
        .repartition(shards, "shard", "part")
        .sortWithinPartitions("shard", "part", "kind")
        .select("kind", "line", "digest", "arrays")
        .mapInArrow(_probe(min_docs), "digest binary, line long")
        .groupBy("digest")
        .agg(F.collect_set("line").alias("lines"))
    )


def drop_frequent_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    count_copies: bool = True,
) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, *keep), one row per row of ``docs``.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at
    least ``min_chars`` code points (1 or more) in at least ``min_docs`` rows (2 to 65535) lose all their
    lines; the others stay as they are, joined by a line feed. Each row counts as a document, also
    one that repeats an id; without ``count_copies`` rows of equal text count as one, so that the lines
    of a text that exists often, but only as copies, stay. A null or empty text is one empty line.
    """
    if not (2 <= min_docs <= 65535 and min_chars >= 1):
        raise ValueError("min_docs must be 2 to 65535, min_chars 1 or more")
    rows = id_text(docs, id_col, text_col)
    rare = frequent_lines(rows, min_docs, min_chars, count_copies)
    others = [F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)]
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *others
    ).withColumn("digest", text_digest(F.col("text")))
    joined = texts.join(rare, "digest", "left").drop("digest")
    joined = joined.select("doc_id", "text", "lines", *[f"keep{k}" for k in range(len(keep))])
    kinds = dict(joined.dtypes)
    schema = "doc_id long, text string, n_lines long, n_dropped long" + "".join(
        f", keep{k} {kinds[f'keep{k}']}" for k in range(len(keep))
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                lines = text.split(b"\n")
                kept = lines
                if drop:
                    gone = set(drop)
                    kept = [x for x, h in zip(lines, line_hashes(lines, min_chars)) if h not in gone]
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()),
                 pa.array(n_dropped, pa.int64()), *(batch.column(k) for k in range(3, batch.num_columns))],
                ["doc_id", "text", "n_lines", "n_dropped", *(f"keep{k}" for k in range(len(keep)))],
            )

    out = joined.mapInArrow(step, schema)
    return out.withColumnsRenamed({f"keep{k}": c for k, c in enumerate(keep)})


def digests(kept: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of ``drop_frequent_lines``' rows."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
