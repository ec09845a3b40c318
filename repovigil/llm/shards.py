"""Sharding by sampled splitters: shards of nearly equal bytes, equal texts side by side.

Records are ordered by (hash of the text, id, number); the key is unique, so every set of records can
be divided, also a third of them with one text. A size-weighted sample of keys gives quantile
boundaries for many more ranges than shards. Ranges that turn out overfull, in bytes or in records,
are divided again by a sample of their own. Records are then sorted within their ranges, and the sums
of the earlier ranges turn places in a range into places in the whole order. Shard boundaries are cut
there at equal bytes. A boundary inside a group of equal texts moves to the group's edge if that costs at
most ``SLACK`` of a shard; larger groups are divided.

Only narrow keys are shuffled. The driver sees the sample (``OVERSAMPLE`` keys a range), one row for each
range and one for each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repovigil.llm.common import shuffle_partitions
from repovigil.session import written

SHARDS = 8
MOST_RANGES = 16_384
OVERSAMPLE = 16
SLACK = 0.01
_KEY = ["hash", "id", "number"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    )
    # a number of its own for each record, fixed by writing it down
    return written(
        rows.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn(
            "number", F.monotonically_increasing_id()
        ),
        "shard-keys",
    )


class Splitters:
    """Sorted unique keys; a record's range is the number of splitters not above its key."""

    def __init__(self, keys: list[tuple[int, int, int]]):
        self.keys = sorted(set(keys))
        self.columns = [np.array([k[c] for k in self.keys], np.int64) for c in range(3)]

    def ranges(self, *key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key[0]), np.int64)
        if self.keys:
            self._search(key, 0, np.arange(len(out)), 0, len(self.keys), out)
        return out

    def _search(self, key, c, rows, lo, hi, out):
        """Places of ``rows`` among the splitters lo to hi, which agree in the columns before c."""
        own, column = key[c][rows], self.columns[c][lo:hi]
        left = np.searchsorted(column, own, "left") + lo
        right = np.searchsorted(column, own, "right") + lo
        if c == 2:
            out[rows] = right
            return
        out[rows] = left
        tied = np.flatnonzero(right > left)
        for at in np.unique(left[tied]):
            here = tied[left[tied] == at]
            self._search(key, c + 1, rows[here], int(at), int(right[here[0]]), out)


def _place(shared):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            key = [batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in _KEY]
            place = shared.value.ranges(*key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32))], [*names, "range"])

    return step


def _ranged(keyed: DataFrame, splitters: Splitters) -> DataFrame:
    shared = keyed.sparkSession.sparkContext.broadcast(splitters)
    fields = ", ".join(f"{n} {t}" for n, t in keyed.dtypes)
    return keyed.mapInArrow(_place(shared), fields + ", range int")


def _sampled(rows: DataFrame, chance, purpose: str):
    """Rows kept with a chance each, by a hash of the key: the same rows whenever it is run."""
    draw = F.pmod(F.xxhash64(*_KEY, F.lit(purpose)), F.lit(1 << 53)) / float(1 << 53)
    return rows.where(draw < chance)


def _quantiles(keys: list[tuple], weights: list[float], parts: int) -> list[tuple]:
    """parts - 1 keys that divide the sorted sample into equal weights."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    sums = np.cumsum([weights[k] for k in order])
    if not len(order) or parts < 2:
        return []
    at = np.searchsorted(sums, sums[-1] * np.arange(1, parts) / parts, "left")
    return [keys[order[k]] for k in np.minimum(at, len(order) - 1)]


def _choose(keyed: DataFrame, ranges: int, total: int, rows: int) -> Splitters:
    want = OVERSAMPLE * ranges
    found = _sampled(keyed, F.col("size") * (want / total), "first").select(*_KEY, "size").collect()
    first = _quantiles([tuple(r[:3]) for r in found], [max(r[3], total / want) for r in found], ranges)
    splitters = Splitters(first)
    for turn in range(3):
        loads = {r[0]: (r[1], r[2]) for r in _ranged(keyed, splitters).groupBy("range").agg(
            F.sum("size"), F.count("*")).collect()}
        parts = {
            k: int(max(b * ranges / total, n * ranges / rows)) + 1
            for k, (b, n) in loads.items()
            if n > 1 and max(b * ranges / total, n * ranges / rows) > 2
        }
        if not parts:
            break
        table = keyed.sparkSession.createDataFrame(
            [(k, float(loads[k][0]), float(loads[k][1]), float(OVERSAMPLE * p)) for k, p in parts.items()],
            "range int, bytes double, records double, want double",
        )
        inside = _ranged(keyed, splitters).join(F.broadcast(table), "range")  # at most one row a range
        weight = F.col("size") / F.col("bytes") + 1 / F.col("records")
        more = _sampled(inside, weight * F.col("want") / 2, f"turn {turn}").select("range", *_KEY, weight).collect()
        by_range: dict[int, list] = {}
        for r in more:
            by_range.setdefault(r[0], []).append(r)
        added = [
            key for k, own in by_range.items()
            for key in _quantiles([tuple(r[1:4]) for r in own], [r[4] for r in own], parts[k])
        ]
        splitters = Splitters(splitters.keys + added)
    return splitters


def _ordered(keyed: DataFrame, splitters: Splitters) -> DataFrame:
    """Records with ``place`` (from 0) and ``upto`` (bytes up to and with the record) in the order."""
    ranged = _ranged(keyed, splitters)
    sums = sorted(ranged.groupBy("range").agg(F.sum("size"), F.count("*")).collect())
    before, rows, bytes_ = [], 0, 0
    for r in sums:
        before.append((r[0], rows, bytes_))
        bytes_, rows = bytes_ + r[1], rows + r[2]
    offsets = keyed.sparkSession.createDataFrame(before, "range int, rows_before long, bytes_before long")
    inside = Window.partitionBy("range").orderBy(*_KEY)
    placed = ranged.repartition(shuffle_partitions(keyed.sparkSession), "range").select(
        "*",
        F.row_number().over(inside).alias("nth"),
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"),
    )
    return placed.join(F.broadcast(offsets), "range").select(
        "doc_id", "size", "text_crc32", "hash",
        (F.col("rows_before") + F.col("nth") - 1).alias("place"), (F.col("bytes_before") + F.col("bytes")).alias("upto"),
    )


def _cuts(ordered: DataFrame, shards: int, total: int, rows: int) -> list[int]:
    """The place where each shard but the first begins."""
    part = lambda b: F.floor((b * shards) / F.lit(total))
    inside = F.col("upto") - F.col("size")
    crossing = ordered.where(part(F.col("upto")) > part(inside)).select("hash", "place", "upto", "size").collect()
    spark = ordered.sparkSession
    hashes = spark.createDataFrame([(h,) for h in {r["hash"] for r in crossing}], "hash long")
    groups = {
        r["hash"]: r
        for r in ordered.join(F.broadcast(hashes), "hash").groupBy("hash").agg(
            F.min(inside).alias("low"), F.max("upto").alias("high"), F.min("place").alias("first"),
            F.max("place").alias("last"),
        ).collect()  # a row a shard
    }
    cuts = []
    for k in range(1, shards):
        target = k * total / shards
        row = next((r for r in sorted(crossing, key=lambda r: r["place"]) if r["upto"] >= target), None)
        if row is None:
            cuts.append(rows)
            continue
        group = groups[row["hash"]]
        edges = [(row["upto"] - row["size"], row["place"]), (row["upto"], row["place"] + 1)]
        whole = [(group["low"], group["first"]), (group["high"], group["last"] + 1)]
        near = max(SLACK * total / shards, row["size"])
        choice = [e for e in whole if abs(e[0] - target) <= near] or edges
        cuts.append(min(choice, key=lambda e: (abs(e[0] - target), e))[1])
    return [max(cuts[: k + 1]) for k in range(len(cuts))]


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, hash, shard, slot), one row per row of ``docs``.

    ``size`` is the UTF-8 length of the text plus 1, so a null or empty text weighs 1 (its checksum is
    0). ``slot`` counts from 0 within a shard. Rows without an id come first among equal texts;
    repeated rows are records of their own. With fewer records than shards some shards stay empty. At
    most 1024 shards.
    """
    if not 1 <= shards <= 1024:
        raise ValueError("shards must be 1 to 1024")
    keyed = _keyed(docs, id_col, text_col)
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not rows:
        empty = F.lit(0)
        return keyed.select("doc_id", "size", "text_crc32", "hash", empty.alias("shard"), empty.cast("bigint").alias("slot"))
    ranges = min(MOST_RANGES, 4 * max(shards, shuffle_partitions(docs.sparkSession)))
    ordered = written(_ordered(keyed, _choose(keyed, ranges, total, rows)), "shard-order")
    starts = F.lit([0, *_cuts(ordered, shards, total, rows)]).cast("array<bigint>")
    shard = F.size(F.filter(starts, lambda s: s <= F.col("place"))) - 1
    return ordered.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "hash", "shard",
        (F.col("place") - F.element_at(starts, F.col("shard") + 1)).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` below ``path`` as one folder ``shard=N`` for each shard, with a ``slot`` column.

    Rows of one id and text are told apart by numbering them; which gets which slot is open.
    """
    same = Window.partitionBy("_id", "_hash").orderBy("_order")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumns(
        {"_id": F.col(id_col).cast("bigint"), "_hash": F.xxhash64(text), "_order": F.lit(0)}
    ).withColumn("_nth", F.row_number().over(same))
    own = Window.partitionBy("doc_id", "hash").orderBy("shard", "slot")
    assigned = assign_shards(docs, shards, id_col, text_col).withColumn("nth", F.row_number().over(own)).select(
        F.col("doc_id").alias("_aid"), F.col("hash").alias("_ahash"), F.col("nth").alias("_anth"), "shard", "slot"
    )
    joined = rows.join(
        assigned,
        F.col("_id").eqNullSafe(F.col("_aid")) & (F.col("_hash") == F.col("_ahash")) & (F.col("_nth") == F.col("_anth")),
    )
    extra = ["_id", "_hash", "_order", "_nth", "_aid", "_ahash", "_anth"]
    joined.drop(*extra).repartition(shuffle_partitions(docs.sparkSession), "shard", F.floor(F.col("slot") / 100_000)).write.partitionBy(
        "shard"
    ).parquet(path)
