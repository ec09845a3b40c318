"""Fill-in-middle over compressed frames against a plain version on whole strings."""

import hashlib
import random
import re

import pytest
from fixtures import documents, frame

from repovigil.llm import fill_middle as fim

MARKED = [(400, "a <P> b"), (401, "<S>"), (402, "x<M>"), (403, "<" * 50), (404, "P>S>M><"), (405, "<S" * 40 + "\n<"), (-7, "minus"), (None, "<P>")]
ROWS = documents() + MARKED
by_all = lambda rows: sorted(rows, key=repr)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, hexed = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(hexed[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h4 % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), out, text


@pytest.fixture(scope="module")
def filled(spark):
    return {u: fim.fill_middle(fim.store(frame(spark, ROWS), frame_units=u)) for u in (3, fim.FRAME_UNITS)}


@pytest.mark.parametrize("units", [3, fim.FRAME_UNITS])
def test_equals_plain_version(filled, units):
    expected = [plain(*r) for r in ROWS]
    assert {e[2] for e in expected} == {"plain", "psm", "spm"}
    got = fim.digests(filled[units]).collect()
    assert by_all(map(tuple, got)) == by_all((*e[:5], sha(e[5]), sha(e[6])) for e in expected)
    assert by_all(map(tuple, fim.texts(filled[units]).collect())) == by_all((e[0], e[2], e[5]) for e in expected)
    for r in filled[units].collect():
        fim_text = b"".join(fim.restored(r["form"], r["frames"])).decode()
        assert (r["doc_id"], fim_text) in {(d, t or "") for d, t in ROWS}


def test_nothing(spark):
    out = fim.digests(fim.fill_middle(fim.store(spark.createDataFrame([], "doc_id long, text string"))))
    assert out.count() == 0 and out.columns[-1] == "restored_sha256"


def test_units_over_pieces(monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(fim, "_PIECE", 7)
    for _ in range(300):
        text = "".join(r.choice("aZ .é🙂\n9") for _ in range(r.randint(0, 60)))
        starts = [int(s) for part in fim.unit_starts(text.encode()) for s in part]
        units = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        assert starts == [len(text[:u].encode()) for u in units]
        n, chars, frames = fim.frames_of(text.encode(), frame_units=4)
        assert (n, chars) == (len(units), len(text))
        assert [f["chars_before"] for f in frames] == units[::4]
        assert b"".join(fim.unpacked([f["data"] for f in frames])).decode() == text


def test_only_cut_frames_are_opened():
    text = " ".join(f"w{i}" for i in range(50_000))
    n, chars, frames = fim.frames_of(text.encode())
    assert len(frames) > 30
    reader = fim.FrameReader(n, chars, frames)
    form, _, _, out = fim.rearrange(1, reader, False, rate=100)
    assert form != "plain" and reader.opened <= 2
    stored = {f["data"] for f in frames}
    assert len(out) - sum(f in stored for f in out) <= 3 + 4  # markers and both halves of two frames


def test_markers_across_frames():
    """Texts that end in the beginning of a marker, cut into frames of one unit."""
    for text in ("<", "<S", "ab<S", "x<<M", "<P<S<M", "S>", ">M>"):
        for doc_id in range(30):
            n, chars, frames = fim.frames_of(text.encode(), frame_units=1)
            form, _, _, out = fim.rearrange(doc_id, fim.FrameReader(n, chars, frames), False, rate=100)
            assert b"".join(fim.restored(form, out)).decode() == text
