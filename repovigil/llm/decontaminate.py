"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are windows of ``width`` consecutive benchmark words; a shorter item is one window.
Patterns of one length share three tables: the *shift* table says how far the search may jump when
it sees a block of two words, the *suffix* buckets hold the patterns that end in a block, and a
direct comparison confirms a pattern. Documents are read in one pass and never shuffled.

The tables of a benchmark of any size are built in blocks of at most ``block_words`` words, the
only data that is broadcast. Documents pass the blocks one after the other and carry what was found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repovigil.llm.common import as_bytes, id_text, slices
from repovigil.session import written

WIDTH = 10
BLOCK_WORDS = 1_000_000
PIECE_WORDS = 10_000
#: Bytes that belong to words are 0-9, a-z and all of 0x80-0xFF; A-Z count as a-z.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Patterns:
    """Shift tables and suffix buckets of a block of the benchmark, by pattern length."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], width: int):
        self.ids: list[int | None] = sorted({i for i, _ in items}, key=lambda i: (i is not None, i))
        place = {item: k for k, item in enumerate(self.ids)}
        self.symbols: dict[bytes, int] = {}
        owners: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, words in items:
            seq = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words]
            size = min(width, len(seq))
            for k in range(len(seq) - size + 1 if size else 0):
                owners.setdefault(size, {}).setdefault(tuple(seq[k : k + size]), set()).add(place[item])
        self.base = len(self.symbols) + 1
        self.groups = [(size, *self._tables(size, found)) for size, found in sorted(owners.items())]

    def _tables(self, size, found):
        block = min(2, size)
        shift: dict[int, int] = {}
        suffix: dict[int, list] = {}
        for pattern, items in found.items():
            for end in range(block, size + 1):
                key = self._key(pattern[end - block : end])
                shift[key] = min(shift.get(key, size), size - end)
            suffix.setdefault(key, []).append((list(pattern), tuple(items)))
        return block, shift, suffix

    def _key(self, block) -> int:
        return block[-1] if len(block) == 1 else block[0] * self.base + block[1]

    def search(self, words: list[bytes]) -> tuple[set[tuple[int, int]], set[int]]:
        """Spans of confirmed windows and the places of their items in ``ids``."""
        get = self.symbols.get
        seq = [get(w, 0) for w in words]
        spans: set[tuple[int, int]] = set()
        items: set[int] = set()
        base, n = self.base, len(seq)
        for size, block, shift, suffix in self.groups:
            jump, at = size - block + 1, size - 1
            while at < n:
                key = seq[at - 1] * base + seq[at] if block == 2 else seq[at]
                step = shift.get(key, jump)
                if step:
                    at += step
                    continue
                window = seq[at - size + 1 : at + 1]
                for pattern, own in suffix[key]:
                    if pattern == window:
                        spans.add((at - size + 1, at + 1))
                        items.update(own)
                at += 1
        return spans, items


def _pieces(width: int):
    """Items as pieces that overlap by ``width - 1`` words, so that no piece is large."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = split_words(text)
                for start in range(0, max(1, len(words) - width + 1), PIECE_WORDS):
                    part = words[start : start + PIECE_WORDS + width - 1]
                    if part:
                        out.append((item, b" ".join(part), len(part)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64()))],
                    ["item_id", "words", "n"],
                )

    return step


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, block_words: int) -> Iterator[Patterns]:
    pieces = id_text(benchmark, id_col, text_col).mapInArrow(_pieces(width), "item_id long, words binary, n long")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-total // block_words))
    placed = pieces.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(parts)))
    for part in range(parts):
        # about block_words words, whatever the size of the benchmark
        rows = placed.where(F.col("part") == part).select("item_id", "words").collect()
        yield Patterns([(r[0], bytes(r[1]).split(b" ")) for r in rows], width)


_FOUND = "doc_id long, text string, starts array<int>, ends array<int>, items array<long>, anonymous boolean"
_NAMES = ["doc_id", "text", "starts", "ends", "items", "anonymous"]


def _scan(shared):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: Patterns = shared.value
        for batch in slices(batches):
            starts, ends, items, anonymous = [], [], [], []
            for text, s, e, i, a in zip(as_bytes(batch.column(1)), *(batch.column(k).to_pylist() for k in range(2, 6))):
                spans, hit = patterns.search(split_words(text)) if text else ((), ())
                spans = sorted({*zip(s, e), *spans})
                found = {*i, *(patterns.ids[k] for k in hit)}
                starts.append([x[0] for x in spans])
                ends.append([x[1] for x in spans])
                anonymous.append(a or None in found)
                items.append(sorted(found - {None}))
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(starts, ints), pa.array(ends, ints),
                 pa.array(items, longs), pa.array(anonymous, pa.bool_()),
                 *(batch.column(k) for k in range(6, batch.num_columns))],
                [*_NAMES, *(f"keep{k}" for k in range(batch.num_columns - 6))],
            )

    return step


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    block_words: int = BLOCK_WORDS,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, text, starts, ends, items, anonymous, *keep), one row per row of ``docs``.

    ``starts`` and ``ends`` are the word spans of all windows found, ``items`` the sorted distinct
    ids of their items; ``anonymous`` says that an item without an id was found too. A null or
    empty text has no words. An item without words is never found; repeated items are one item.
    """
    spark = docs.sparkSession
    none = F.array().cast("array<int>")
    out = docs.select(
        F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        none.alias("starts"), none.alias("ends"), F.array().cast("array<bigint>").alias("items"),
        F.lit(False).alias("anonymous"), *[F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)],
    )
    schema = _FOUND + "".join(f", keep{k} {dict(out.dtypes)[f'keep{k}']}" for k in range(len(keep)))
    for k, patterns in enumerate(_blocks(benchmark, item_col, item_text_col, width, block_words)):
        if k:
            out = written(out, "decontaminate")
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(patterns)), schema)
    return out.withColumnsRenamed({f"keep{k}": c for k, c in enumerate(keep)})


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, hits, items, digests = [], [], [], []
        for text, starts, ends, found, anonymous in zip(
            as_bytes(batch.column(1)), *(batch.column(k).to_pylist() for k in range(2, 6))
        ):
            covered, reach = 0, 0
            for start, end in zip(starts, ends):
                covered += max(0, end - max(start, reach))
                reach = max(reach, end)
            words.append(len(split_words(text)))
            hits.append(covered)
            items.append(len(found) + anonymous)
            names = sorted(map(str, found)) if not anonymous else sorted(["", *map(str, found)])
            digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.int64()),
             pa.array(digests, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination_report(found: DataFrame) -> DataFrame:
    """Counts and a digest of the item ids per document from ``find_benchmark``'s rows.

    An item without an id counts as one item with an empty name.
    """
    return found.mapInArrow(
        _report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )
