"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME_UNITS`` units each, with the units and
code points that lie before each frame. A unit is a run of the letters A-Z and a-z, or any other single
code point. Two cut points, drawn from a hash of the document's id, divide the units into prefix, middle
and suffix: binary search in the cumulative counts finds the frames that hold the cuts, and only those are
decompressed and compressed again. All others move to their place in the output as they are. Digests stream
the frames in order, one decompressed frame at a time.

Nothing is shuffled; a document's frames stay in one row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from repovigil.llm.common import as_bytes, id_text

FRAME_UNITS = 4096
LEVEL = 3
SEED = "1"
#: Of a hundred documents, how many are transformed, and how many of those begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes of text that are cut at once, and bytes of texts or frames that make a batch.
_PIECE, _BATCH = 1 << 20, 4 << 20
#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_BYTES = np.arange(256)
_LETTER = (_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 97) & (_BYTES <= 122)
_CONTINUES = (_BYTES & 0xC0) == 0x80

_FRAME = pa.struct(
    [("units_before", pa.int64()), ("chars_before", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]
)
STORE = (
    "doc_id long, n long, n_chars long, marked boolean, "
    "frames array<struct<units_before: bigint, chars_before: bigint, bytes: bigint, data: binary>>"
)
_STORE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(_FRAME)]
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"
_OUTPUT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
DIGESTS = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
)


def unit_starts(data: bytes) -> Iterator[np.ndarray]:
    """Byte offsets at which units begin, in pieces."""
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole), _PIECE):
        piece = whole[max(0, at - 1) : at + _PIECE]
        letter = _LETTER[piece]
        starts = ~letter & ~_CONTINUES[piece]
        starts[1:] |= letter[1:] & ~letter[:-1]
        if at == 0:
            starts[0] = True
        yield np.flatnonzero(starts[1:] if at else starts) + at


def _code_points(data: bytes) -> int:
    return len(data) - int(np.count_nonzero(_CONTINUES[np.frombuffer(data, np.uint8)]))


def frames_of(text: bytes, frame_units: int = FRAME_UNITS, level: int = LEVEL) -> tuple[int, int, list[dict]]:
    """Units and code points of a text, and its frames."""
    cuts, n = [], 0
    for starts in unit_starts(text):
        cuts += starts[-n % frame_units :: frame_units].tolist()
        n += len(starts)
    packer = zstandard.ZstdCompressor(level=level)
    frames, chars = [], 0
    for k, (start, stop) in enumerate(zip(cuts, [*cuts[1:], len(text)])):
        part = text[start:stop]
        frames.append(
            {"units_before": k * frame_units, "chars_before": chars, "bytes": len(part), "data": packer.compress(part)}
        )
        chars += _code_points(part)
    return n, chars, frames


class FrameReader:
    """Reads parts of a stored text by unit numbers; ``opened`` counts the frames it decompressed."""

    def __init__(self, n: int, n_chars: int, frames: list[dict], level: int = LEVEL):
        self.n, self.n_chars, self.frames, self.opened = n, n_chars, frames, 0
        self._before = [f["units_before"] for f in frames]
        self._open: dict[int, tuple[bytes, np.ndarray]] = {}
        self._packer = zstandard.ZstdCompressor(level=level)

    def _at(self, unit: int) -> tuple[int, int, int]:
        """Frame, byte and code point offset in it at which a unit begins."""
        if unit >= self.n:
            return len(self.frames), 0, self.n_chars
        k = bisect_right(self._before, unit) - 1
        frame = self.frames[k]
        if unit == frame["units_before"]:
            return k, 0, frame["chars_before"]
        if k not in self._open:
            data = zstandard.ZstdDecompressor().decompress(frame["data"])
            self._open[k] = data, np.concatenate(list(unit_starts(data)))
            self.opened += 1
        data, starts = self._open[k]
        offset = int(starts[unit - frame["units_before"]])
        return k, offset, frame["chars_before"] + _code_points(data[:offset])

    def chars_before(self, unit: int) -> int:
        return self._at(unit)[2]

    def part(self, start: int, stop: int) -> Iterator[bytes]:
        """The units from ``start`` to ``stop`` as frames; whole ones as they are stored."""
        (first, skip, _), (last, end, _) = self._at(start), self._at(stop)
        if start >= stop:
            return
        for k in range(first, last + (end > 0)):
            low, high = skip if k == first else 0, end if k == last else None
            if low or high is not None:
                yield self._packer.compress(self._open[k][0][low:high])
            else:
                yield self.frames[k]["data"]


def _hashes(doc_id: int | None, seed: str) -> list[int]:
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[k : k + 8], 16) for k in range(0, 32, 8)]


def rearrange(
    doc_id: int | None, reader: FrameReader, marked: bool, seed: str = SEED, rate: int = RATE, spm: int = SUFFIX_FIRST
) -> tuple[str, int | None, int | None, list[bytes]]:
    """Form, code points of prefix and middle, and the output as frames."""
    h1, h2, h3, h4 = _hashes(doc_id, seed)
    if not reader.n or marked or h3 % 100 >= rate:
        return "plain", None, None, [f["data"] for f in reader.frames]
    a, b = sorted((h1 % (reader.n + 1), h2 % (reader.n + 1)))
    pack = zstandard.ZstdCompressor().compress
    prefix = [pack(PREFIX), *reader.part(0, a)]
    suffix = [pack(SUFFIX), *reader.part(b, reader.n)]
    middle = [pack(MIDDLE), *reader.part(a, b)]
    form = "spm" if h4 % 100 < spm else "psm"
    chars = reader.chars_before(a)
    order = [*suffix, *prefix, *middle] if form == "spm" else [*prefix, *suffix, *middle]
    return form, chars, reader.chars_before(b) - chars, order


def unpacked(frames: list[bytes]) -> Iterator[bytes]:
    """The text of ordered frames, one decompressed frame at a time."""
    opener = zstandard.ZstdDecompressor()
    for frame in frames:
        yield opener.decompress(frame)


def _scan(frames: list[bytes]) -> tuple[str, list[int], dict[bytes, int]]:
    """One pass: digest of the output, bytes up to each frame, first place of each marker."""
    digest, upto, places, tail = hashlib.sha256(), [0], {}, b""
    for data in unpacked(frames):
        digest.update(data)
        seen = tail + data
        for marker in (PREFIX, SUFFIX, MIDDLE):
            if marker not in places and (at := seen.find(marker)) >= 0:
                places[marker] = upto[-1] - len(tail) + at
        upto.append(upto[-1] + len(data))
        tail = seen[-2:]
    return digest.hexdigest(), upto, places


def _between(frames: list[bytes], upto: list[int], start: int, stop: int) -> Iterator[bytes]:
    first = bisect_right(upto, start) - 1
    for k in range(first, len(frames)):
        if upto[k] >= stop:
            return
        data = next(unpacked(frames[k : k + 1]))
        yield data[max(0, start - upto[k]) : stop - upto[k]]


def restored(form: str, frames: list[bytes]) -> Iterator[bytes]:
    """The original text from an output and its form: markers are looked for in the output itself."""
    if form == "plain":
        yield from unpacked(frames)
        return
    _, upto, places = _scan(frames)
    yield from _restored(form, frames, upto, places)


def _restored(form: str, frames: list[bytes], upto: list[int], places: dict[bytes, int]) -> Iterator[bytes]:
    p, s, m, end = places[PREFIX], places[SUFFIX], places[MIDDLE], upto[-1]
    prefix, suffix = ((p + 3, s), (s + 3, m)) if form == "psm" else ((p + 3, m), (s + 3, p))
    for start, stop in (prefix, (m + 3, end), suffix):
        yield from _between(frames, upto, start, stop)


def _rows(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``_BATCH`` bytes."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight > _BATCH or len(held) >= 1000:
            yield _batch(held, types, names)
            held, weight = [], 0
    if held:
        yield _batch(held, types, names)


def _batch(rows, types, names):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def store(
    docs: DataFrame, frame_units: int = FRAME_UNITS, level: int = LEVEL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n, n_chars, marked, frames), one row per row of ``docs``.

    ``n`` counts the units, ``marked`` says that the text holds a marker. A null or empty text has no
    frames. Repeated rows are stored repeatedly, other columns are not read. A single unit is never
    divided, so a frame is as long as its longest run of letters wants.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for k in range(0, batch.num_rows, 100):
                    part = batch.slice(k, 100)
                    for doc_id, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                        n, chars, frames = frames_of(text, frame_units, level)
                        yield doc_id, n, chars, any(m in text for m in (PREFIX, SUFFIX, MIDDLE)), frames

        packed = lambda row: sum(len(f["data"]) for f in row[4])
        yield from _rows(rows(), _STORE_TYPES, ["doc_id", "n", "n_chars", "marked", "frames"], packed)

    return id_text(docs, id_col, text_col).mapInArrow(step, STORE)


def fill_middle(stored: DataFrame, seed: str = SEED, rate: int = RATE, spm: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames) from the rows of ``store``.

    ``frames`` is the output in order: the frames of a row, decompressed one after the other, are its
    text. A row is plain if its text is empty or holds a marker, or if its hash says so; its lengths
    are null then. The hash of a row without an id is that of an empty id.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for k in range(0, batch.num_rows, 100):
                    for row in batch.slice(k, 100).to_pylist():
                        reader = FrameReader(row["n"], row["n_chars"], row["frames"])
                        form, prefix, middle, out = rearrange(row["doc_id"], reader, row["marked"], seed, rate, spm)
                        yield row["doc_id"], row["n"], form, prefix, middle, out

        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"]
        yield from _rows(rows(), _OUTPUT_TYPES, names, lambda row: sum(map(len, row[5])))

    return stored.select("doc_id", "n", "n_chars", "marked", "frames").mapInArrow(step, OUTPUT)


def texts(filled: DataFrame) -> DataFrame:
    """(doc_id, form, text) of the rows of ``fill_middle``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (row["doc_id"], row["form"], b"".join(unpacked(row["frames"])).decode())
            for batch in batches
            for k in range(0, batch.num_rows, 100)
            for row in batch.slice(k, 100).to_pylist()
        )
        yield from _rows(rows, [pa.int64(), pa.string(), pa.string()], ["doc_id", "form", "text"], lambda row: len(row[2]))

    return filled.select("doc_id", "form", "frames").mapInArrow(step, "doc_id long, form string, text string")


def digests(filled: DataFrame) -> DataFrame:
    """Digests of the output and of the text rebuilt from output and form, by streaming the frames."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for k in range(0, batch.num_rows, 100):
                    for row in batch.slice(k, 100).to_pylist():
                        frames, form = row.pop("frames"), row["form"]
                        output, upto, places = _scan(frames)
                        back = output
                        if form != "plain":
                            digest = hashlib.sha256()
                            for piece in _restored(form, frames, upto, places):
                                digest.update(piece)
                            back = digest.hexdigest()
                        yield *row.values(), output, back

        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
        yield from _rows(rows(), [*_OUTPUT_TYPES[:5], pa.string(), pa.string()], names, lambda row: 200)

    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"]
    return filled.select(*columns).mapInArrow(step, DIGESTS)
