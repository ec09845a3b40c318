"""N-gram Jaccard join: a size-aware heavy-light join of word-shingle sets.

Two documents link when the Jaccard similarity of their shingle sets reaches ``percent``. Sets that
are equal are one set from the start. Then sets of at most T shingles (light) are cut into all their
subsets of the fixed sizes that a partner must share; larger ones (heavy) are listed under their
rarest shingles, as many as a partner cannot miss. Both give rows (key, set), and every linked pair
meets under a key. T is where the number of subsets plus the expected cost of scanning lists is
least; it comes from the sizes of all sets and from a sketch of all shingle counts.

Lists are scanned without writing out all their pairs, in three rounds. *Shapes*, the numbers of shingles in
the cells of a division of the hash range, tell pairs that cannot be linked, and the likeliest ones.

1. Every list meets two of its members, which a hash chooses, with all others; each set is compared with the
   likeliest of the members it met. The links merge most members of a list into one component. Lists of
   three have all their pairs met.
2. A member outside a list's main component is compared with the likeliest member of each other component.
3. Members still outside are compared with all members of other components that shapes allow.

A pair that is never compared is in one component already, or its shapes rule it out, so no link
between different components is lost.

Shingles and sets are known by 64-bit hashes; a pair of sets is compared by its whole shingle sets, of
which 48 bits of each hash travel. Equal hashes are expected n^2 / 2^65 times among n sets, and m^2 / 2^48
times between two sets of m shingles.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repovigil.llm import sketch
from repovigil.llm.common import as_bytes, id_text, mix, shuffle_partitions, slices, text_digest, word_hashes
from repovigil.llm.components import components
from repovigil.session import written

WORDS = 5
PERCENT = 80
SALT_ROWS = 1_000_000
MOST_LIGHT = 40
_SEEN = 300_000
_CELLS = 128
_COARSE = 32
SHORT_LIST = 3
BLOCK_ROWS = 2048


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as a sorted array of 64-bit hashes.

    A text of fewer words is one shingle, a text without words has none.
    """
    for seq, cuts in word_hashes(texts):
        all_ = _shingles(seq, words)
        for a, b in zip(cuts, cuts[1:]):
            own = all_[a : b - words + 1] if b - a >= words else _shingles(seq[a:b], int(b - a))
            if len(own) > 1:
                own = np.sort(own)
                own = own[np.r_[True, own[1:] != own[:-1]]]
            yield own


def _shingles(seq: np.ndarray, words: int) -> np.ndarray:
    """A hash of every run of ``words`` words."""
    rows = max(0, len(seq) - words + 1) if words else 0
    h = np.zeros(rows, np.uint64)
    for i in range(words if rows else 0):
        h = mix(h ^ seq[i : i + rows], words)
    return h


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def shape(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of 128 cells of the hash range, 255 at most a cell."""
    cells = np.bincount((shingles >> np.uint64(5)).astype(np.int64) % _CELLS, minlength=_CELLS)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def _coarse(shapes: DataFrame) -> DataFrame:
    """(sig, n, shape) with shapes of 32 cells, for the many pairs of the first comparison."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            cells = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, _CELLS // _COARSE, _COARSE)
            few = np.minimum(cells.sum(1, dtype=np.int64), 255).astype(np.uint8)
            # a cell that was cut off at 255 stays at 255
            few[(cells == 255).any(1)] = 255
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in few], pa.binary())], ["sig", "n", "shape"]
            )

    return shapes.select("sig", "n", "shape").mapInArrow(step, "sig long, n int, shape binary")


def _across(percent: int, likeliest: bool):
    """Rows (key, p, q, sig, n, label, rest, shape) sorted by (key, p, q): pairs (a, b) within such a group.

    A set that is not in its list's main component (``rest``) is paired with the sets of other
    components whose sizes and shapes allow a link, or with the likeliest of each component. A group
    has at most about two blocks of rows.
    """

    def pairs(group: list[np.ndarray]) -> tuple[list, list]:
        sig, n, label, rest, cells = (np.concatenate(c) for c in zip(*group))
        a, b = [], []
        for k in np.flatnonzero(rest):
            other = np.flatnonzero(
                (label != label[k]) & (np.minimum(n, n[k]) * 100 >= np.maximum(n, n[k]) * percent)
            )
            differ = np.abs(cells[other] - cells[k]).sum(1)
            fits = np.flatnonzero(differ <= (n[other] + n[k]) * (100 - percent) // (100 + percent))
            if likeliest and len(fits):
                fits = fits[np.lexsort((sig[other[fits]], differ[fits], label[other[fits]]))]
                fits = fits[np.r_[True, label[other[fits[1:]]] != label[other[fits[:-1]]]]]
            found = sig[other[fits]]
            a.append(np.minimum(found, sig[k]))
            b.append(np.maximum(found, sig[k]))
        return a, b

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, a, b = None, [], [], []

        def flush():
            if not a:
                return
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            a.clear()
            b.clear()
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, p, q, sig, n, label, rest = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            cells = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, _CELLS).astype(np.int16)
            same = (key[1:] == key[:-1]) & (p[1:] == p[:-1]) & (q[1:] == q[:-1])
            cuts = [0, *(np.flatnonzero(~same) + 1), len(key)]
            for i, j in zip(cuts, cuts[1:]):
                name = (key[i], p[i], q[i])
                if now is not None and name != now:
                    x, y = pairs(group)
                    a += x
                    b += y
                    group = []
                now = name
                group.append((sig[i:j], n[i:j].astype(np.int64), label[i:j], rest[i:j], cells[i:j]))
            if sum(map(len, a)) > 100_000:
                yield from flush()
        if group:
            x, y = pairs(group)
            a += x
            b += y
        yield from flush()

    return step


def packed(shingles: np.ndarray) -> bytes:
    """A sorted set for travel: the upper 48 bits of its hashes, the uppermost 16 compressed."""
    top, rest = (shingles >> np.uint64(48)).astype(np.uint16), (shingles >> np.uint64(16)).astype(np.uint32)
    return rest.tobytes() + zlib.compress(np.diff(top, prepend=np.uint16(0)).tobytes(), 1) + len(rest).to_bytes(4, "little")


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[-4:], "little")
    top = np.cumsum(np.frombuffer(zlib.decompress(data[4 * n : -4]), np.uint16), dtype=np.uint16)
    return top.astype(np.uint64) << np.uint64(32) | np.frombuffer(data[: 4 * n], np.uint32)


def least_overlap(size: int, percent: int) -> int:
    """Shingles that a set of ``size`` shares with any linked set that is not larger."""
    return -(-percent * size // 100)


def subset_sizes(size: int, percent: int) -> list[int]:
    """Subset sizes that a light set is cut into, one for each size of the larger set of a pair."""
    return sorted({least_overlap(b, percent) for b in range(size, 100 * size // percent + 1)} & {*range(1, size + 1)})


def choose_light(sizes: dict[int, int], percent: int, list_length: float) -> int:
    """The boundary T: light sets have at most T shingles. Least total of keys made and rows scanned.

    ``sizes``: number of sets by number of shingles; ``list_length``: expected length of the list
    of a shingle occurrence.
    """
    best, least = 0, math.inf
    subsets = {n: sum(math.comb(n, c) for c in subset_sizes(n, percent)) for n in range(1, MOST_LIGHT + 1)}
    scan = {n: (n - least_overlap(n, percent) + 1) * (1 + list_length) for n in sizes}
    for t in range(MOST_LIGHT + 1):
        cost = sum(
            count * ((subsets[n] if n <= t else 0) + (scan[n] if n >= least_overlap(t + 1, percent) else 0))
            for n, count in sizes.items()
        )
        if cost < least:
            best, least = t, cost
    return best


def _describe(words: int):
    """First pass: a narrow row for each document, and the sketch of the task's shingles."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(sketch.BUCKETS, np.uint32), set()
        names = ["doc_id", "n", "sig", "digest", "shape", "slice", "counts"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        for batch in slices(batches):
            sizes, sigs, digests, shapes, fresh = [], [], [], [], []
            texts = as_bytes(batch.column(1))
            for text, own in zip(texts, shingle_sets(texts, words)):
                sig = set_id(own) if len(own) else None
                if sig is not None and sig not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(sig)
                    fresh.append(own)
                sizes.append(len(own))
                sigs.append(sig)
                digests.append(hashlib.md5(text).digest())
                shapes.append(shape(own))
            if fresh:
                np.add.at(counts, sketch.bucket_of(np.concatenate(fresh)), 1)
            empty = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, t) for v, t in zip((sizes, sigs, digests, shapes), kinds[1:5])), *empty], names
            )
        found = [*sketch.to_slices(counts)]
        none = [pa.nulls(len(found), t) for t in kinds[:5]]
        yield pa.RecordBatch.from_arrays(
            [*none, pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], names
        )

    return step


def _keys(words: int, percent: int, light: int, shared):
    """Second pass: rows (key, salt, sig, n) for the subsets of light and the rarest shingles of heavy sets.

    A list's salt is 0, or from 1 on if the list is dealt into several parts.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in slices(batches):
            keys, salts, sigs, sizes = [], [], [], []
            for own in shingle_sets(as_bytes(batch.column(1)), words):
                n = len(own)
                if not n or (sig := set_id(own)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(sig)
                salt = sig & 0xFFFFFFFF
                found, parts = [], []
                if n <= light:
                    for c in subset_sizes(n, percent):
                        subsets = np.array([*combinations(own.tolist(), c)], np.uint64)
                        h = np.full(len(subsets), c, np.uint64)
                        for i in range(c):
                            h = mix(h ^ subsets[:, i], 77)
                        found.append(h)
                        parts.append(np.zeros(len(h), np.int64))
                if n >= least_overlap(light + 1, percent):
                    load = counts[sketch.bucket_of(own)]
                    # by load, then by hash: own is sorted and the sort keeps the order of equal keys
                    order = load.astype(np.uint64) << np.uint64(32) | own >> np.uint64(32)
                    rare = np.argsort(order, kind="stable")[: n - least_overlap(n, percent) + 1]
                    found.append(own[rare])
                    dealt = 1 + load[rare].astype(np.int64) // SALT_ROWS
                    parts.append(np.where(dealt > 1, 1 + salt % dealt, 0))
                for h, p in zip(found, parts):
                    keys.append(h.view(np.int64))
                    salts.append(p)
                    sigs += [sig] * len(h)
                    sizes += [n] * len(h)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(salts).astype(np.int32)),
                     pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32())],
                    ["key", "salt", "sig", "n"],
                )

    return step


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, salt, sig, n) sorted by them: drops repeated rows and lists of one set.

    A list that was dealt into several salted parts keeps all rows. Only the last row is remembered
    from batch to batch.
    """
    names = ["key", "sig", "n"]
    last = None  # key, salt, sig, n of the last row, and whether it was handed on
    for batch in batches:
        key, salt, sig, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(key):
            continue
        if last is not None:
            key, salt, sig, n = (np.concatenate([[v], c]).astype(c.dtype) for v, c in zip(last, (key, salt, sig, n)))
        same_list = np.r_[False, (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])]
        repeated = same_list & np.r_[False, sig[1:] == sig[:-1]]
        handed = last is not None and last[4]
        keep = np.flatnonzero(~repeated)
        key, salt, sig, n = key[keep], salt[keep], sig[keep], n[keep]
        same = np.r_[False, (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])]
        wanted = same | np.r_[same[1:], False] | (salt > 0)
        if handed:
            out = wanted.copy()
            out[0] = False
        else:
            out = wanted
        last = (key[-1], salt[-1], sig[-1], n[-1], bool(wanted[-1]) or (handed and len(key) == 1))
        rows = np.flatnonzero(out)
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[rows]), pa.array(sig[rows]), pa.array(n[rows].astype(np.int32))], names
            )


def _sets(words: int, shared):
    """(sig, items): the shingles of texts whose digest the sketch of wanted digests knows."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in slices(batches):
            texts = []
            for text in as_bytes(batch.column(1)):
                d = hashlib.md5(text).digest()
                if d in seen or not counts[sketch.bucket_of(np.frombuffer(d[:8], np.uint64))[0]]:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(d)
                texts.append(text)
            sets = [*shingle_sets(texts, words)]
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_id(x) for x in sets], pa.int64()), pa.array([packed(x) for x in sets], pa.binary())],
                    ["sig", "items"],
                )

    return step


def _digest_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(sketch.BUCKETS, np.uint32)
    for batch in batches:
        heads = [d[:8] for d in batch.column(0).to_pylist()]
        np.add.at(counts, sketch.bucket_of(np.frombuffer(b"".join(heads), np.uint64)), 1)
    found = [*sketch.to_slices(counts)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], ["slice", "counts"]
    )


def _possible(percent: int):
    """Pairs (sig, sig2, sizes, shapes) whose shapes do not differ by more shingles than linked sets may."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            if not batch.num_rows:
                continue
            n1, n2 = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            one, two = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, _COARSE).astype(np.int32)
                for k in (4, 5)
            )
            differ = np.abs(one - two).sum(1)
            # both >= percent * all / 100 and all + both = n1 + n2: at most this many are in one set alone
            most = (n1 + n2) * (100 - percent) // (100 + percent)
            rows = pa.array(np.flatnonzero(differ <= most))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(differ[differ <= most])],
                ["sig", "sig2", "differ"],
            )

    return step


def _compare(percent: int):
    """Rows (a, b, one, two) with the sets of a pair: the pairs that are similar enough."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = unpacked(x), unpacked(y)
                both = len(np.intersect1d(a, b))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            rows = pa.array(np.flatnonzero(linked))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["a", "b"])

    return step


def _links(pairs: DataFrame, rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose whole sets are similar enough.

    Sets are dealt by their ids once; for each pair one of the two travels on to the other.
    """
    sigs = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = rows.join(sigs, "sig").groupBy("sig").agg(F.min("digest").alias("digest"))
    few = sketch.merged(wanted.select("digest").mapInArrow(_digest_sketch, "slice int, counts binary"))
    sets = texts.mapInArrow(_sets(words, texts.sparkSession.sparkContext.broadcast(few)), "sig long, items binary")
    sets = sets.groupBy("sig").agg(F.first("items").alias("items"))
    one = sets.select(F.col("sig").alias("a"), F.col("items").alias("one"))
    two = sets.select(F.col("sig").alias("b"), F.col("items").alias("two"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "one", "two")
    return written(both.mapInArrow(_compare(percent), "a long, b long"), "links")


def _met(joined: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """Pairs (sig, sig2, differ) of ``joined`` whose sizes and shapes allow a link."""
    fits = (F.col("sig") != F.col("sig2")) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
    met = joined.where(fits).select("sig", "sig2").distinct()
    one = shapes.select("sig", F.col("n").alias("n1"), F.col("shape").alias("s1"))
    two = shapes.select(F.col("sig").alias("sig2"), "n", F.col("shape").alias("s2"))
    both = met.join(one, "sig").join(two, "sig2").select("sig", "sig2", "n1", "n", "s1", "s2")
    return written(both.mapInArrow(_possible(percent), "sig long, sig2 long, differ long"), "met")


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.least("sig", "sig2").alias("a"), F.greatest("sig", "sig2").alias("b")).distinct()


def _likeliest(met: DataFrame) -> DataFrame:
    """The pair of each ``sig`` with the ``sig2`` whose shape differs least."""
    best = met.groupBy("sig").agg(F.min(F.struct("differ", "sig2"))["sig2"].alias("sig2"))
    return _ordered(best)


def _apart(met: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of ``met`` whose two sets are in different components."""
    one = label.select(F.col("id").alias("sig"), F.col("label").alias("l1"))
    two = label.select(F.col("id").alias("sig2"), F.col("label").alias("l2"))
    return met.join(one, "sig", "left").join(two, "sig2", "left").where(
        F.coalesce("l1", "sig") != F.coalesce("l2", "sig2")
    )


def _between_components(
    lists: DataFrame, label: DataFrame, shapes: DataFrame, percent: int, likeliest: bool
) -> DataFrame:
    """Distinct pairs (a, b) of one list, one of them outside the list's main component."""
    placed = lists.join(label.withColumnRenamed("id", "sig"), "sig", "left").withColumn(
        "label", F.coalesce("label", "sig")
    )
    mixed = (
        placed.groupBy("key", "label").count().groupBy("key")
        .agg(
            F.count("*").alias("labels"), F.max(F.struct("count", "label"))["label"].alias("main"),
            F.ceil(F.sum("count") / BLOCK_ROWS).cast("int").alias("blocks"),
        )
        .where("labels > 1")
    )
    # long lists in blocks: a row meets those of its own block and of each other block in groups of their own
    block = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    blocked = placed.join(mixed.select("key", "main", "blocks"), "key").select(
        "key", "sig", "n", "label", (F.col("label") != F.col("main")).alias("rest"), block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    grouped = blocked.join(shapes.select("sig", "shape"), "sig").select(
        "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "sig", "n", "label", "rest", "shape"
    )
    return (
        grouped.repartition(shuffle_partitions(lists.sparkSession), "key", "p", "q").sortWithinPartitions("key", "p", "q")
        .mapInArrow(_across(percent, likeliest), "a long, b long").distinct()
    )


def link_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, sig, digest, component, component_id), one row per row of ``docs``.

    ``sig`` is an id of the shingle set, ``digest`` one of the text, ``component`` one of the
    component. ``component_id`` is the smallest id that links reach, null
    if none of them has one. A text without words has no shingles, no ``sig``, and links with
    nothing: it has no ``component``, and ``component_id`` is its own id. Rows with a null id take part; repeated rows are copies.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    first = written(
        texts.mapInArrow(
            _describe(words), "doc_id long, n int, sig long, digest binary, shape binary, slice int, counts binary"
        ),
        "shingle-sets",
    )
    rows = first.where("slice is null").select("doc_id", "n", "sig", "digest", "shape")
    load = sketch.merged(first.where("slice is not null"))
    # of all light sizes, one number each
    known = rows.where("sig is not null").groupBy("sig").agg(F.min("n").alias("n"))
    sizes = {r[0]: r[1] for r in known.where(F.col("n") <= 2 * MOST_LIGHT).groupBy("n").count().collect()}
    total = float(load.sum())
    squares = float(np.square(load, dtype=np.float64).sum())
    # second moment of the shingle counts, without what chance puts into a bucket
    length = max(1.0, (squares - total * total / sketch.BUCKETS) / max(total, 1.0))
    light = choose_light(sizes, percent, length)

    parts = shuffle_partitions(spark)
    lists = written(
        texts.mapInArrow(_keys(words, percent, light, spark.sparkContext.broadcast(load)), "key long, salt int, sig long, n int")
        .repartition(parts, "key", "salt")
        .sortWithinPartitions("key", "salt", "sig")
        .mapInArrow(_shared_only, "key long, sig long, n int"),
        "shingle-lists",
    )
    # two members of each list against all: the smallest and the largest by a hash are never the same
    by_hash = F.struct(F.xxhash64("sig", "key").alias("h"), "sig", "n")
    chosen = lists.groupBy("key").agg(F.min(by_hash).alias("c0"), F.max(by_hash).alias("c1"))
    centers = chosen.select("key", F.explode(F.array_distinct(F.array("c0", "c1"))).alias("c")).select(
        "key", F.col("c.sig").alias("sig2"), F.col("c.n").alias("n2")
    )
    shapes = rows.where("sig is not null").groupBy("sig").agg(F.min("n").alias("n"), F.min("shape").alias("shape"))
    shapes = written(shapes.join(lists.select("sig").distinct(), "sig", "left_semi"), "shapes")
    met = _met(lists.join(centers, "key"), _coarse(shapes), percent)
    pairs = written(_likeliest(met), "pairs")
    links = _links(pairs, rows, texts, words, percent)
    label = components(links)

    sizes = lists.groupBy("key").count().where(F.col("count") > SHORT_LIST).select("key")
    long_lists = written(lists.join(sizes, "key", "left_semi"), "long-lists")
    for likeliest in (True, False):
        apart = _apart(met, label)
        more = _between_components(long_lists, label, shapes, percent, likeliest).unionByName(
            _likeliest(apart) if likeliest else _ordered(apart)
        )
        more = written(more.distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        pairs = pairs.unionByName(more)
        links = links.unionByName(_links(more, rows, texts, words, percent))
        label = components(links)

    members = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("low"))
    members = members.join(label.withColumnRenamed("id", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    lowest = members.groupBy("label").agg(F.min("low").alias("component_id"))
    by_set = members.join(lowest, "label").select("sig", F.col("label").alias("component"), "component_id")
    return rows.join(by_set, "sig", "left").select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        "sig",
        "digest",
        "component",
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, columns: list[str], words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``columns`` of one row of each component, and of every row whose text has no words.

    The row with the smallest ``doc_id`` stays (then the smallest digest of the text, rows without an id
    last; of rows that agree in both, any one). ``columns`` must hold ``doc_id`` and ``text``.
    """
    linked = link_components(docs, words, percent)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    chosen = linked.where("component is not null").groupBy("component").agg(F.min(first).alias("first"))
    chosen = chosen.select(F.col("first.doc_id").alias("chosen_id"), F.col("first.digest").alias("chosen_digest"))
    own = docs.select(*[F.col(c).alias(f"own{k}") for k, c in enumerate(columns)])
    doc_id, text = F.col(f"own{columns.index('doc_id')}"), F.col(f"own{columns.index('text')}")
    named = own.withColumn("digest", text_digest(text)).withColumn("id", doc_id.cast("bigint"))
    wordless = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = named.where(~wordless).join(
        chosen, (F.col("digest") == F.col("chosen_digest")) & F.col("id").eqNullSafe(F.col("chosen_id"))
    )
    kept = kept.dropDuplicates(["digest", "id"])  # repeated rows of one id and text
    out = [f"own{k}" for k in range(len(columns))]
    return kept.select(*out).unionByName(own.where(wordless)).toDF(*columns)
