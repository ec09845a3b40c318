"""Importance resampling against a plain version with dictionaries."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from brute import ascii_lower
from fixtures import documents, frame

from repovigil.llm import resample

ROWS = documents()
TARGET = [(1, "Of the W1 w2, w3 naïve w1"), (2, None), (3, ""), (3, "it's 漢字 w5 w6 w7"), (None, "w1 w1 w1")]
by_all = lambda rows: sorted(rows, key=repr)


def grams(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, n, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in grams(t, n)[1])
    t = Counter(bucket(f) for _, x in target for f in grams(x, n)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for doc, text in rows:
        words, features = grams(text, n)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([doc, len(words), len(features), weight, score, None])
    long_enough = [r for r in out if r[1] >= least]
    long_enough.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(long_enough[: percent * len(long_enough) // 100]):
        r[5] = k + 1
    return [tuple(r) for r in out]


@pytest.mark.parametrize("n, buckets, least, percent", [(1, 10_000, 20, 10), (2, 97, 1, 50), (3, 1000, 0, 100)])
def test_equals_plain_version(spark, n, buckets, least, percent):
    docs, target = frame(spark, ROWS), frame(spark, TARGET)
    out = resample.resample(docs, target, n, buckets, least, percent)
    assert by_all(map(tuple, out.collect())) == by_all(plain(ROWS, TARGET, n, buckets, least, percent))


def test_small_pieces(monkeypatch):
    """Texts cut into words in many runs of rows, one text longer than a run."""
    monkeypatch.setattr(resample, "_PIECE", 50)
    texts = pa.array([t for _, t in ROWS])
    found = Counter()
    for first, part in resample._pieces(texts):
        for owner, bucket in resample.features(part, 2, 1000):
            found.update(zip((owner + first).tolist(), bucket.tolist()))
    expected = Counter((k, zlib.crc32(f.encode()) % 1000) for k, (_, t) in enumerate(ROWS) for f in grams(t, 2)[1])
    assert found == expected


def test_repeated_rows_are_drawn_side_by_side(spark):
    """Rows that are alike in everything share no range partition and still get places without gaps."""
    df = spark.range(0, 2000, 1, 6).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "repeat('same words ', 20) AS text")
    out = resample.resample(df, df).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 201)) and len(out) == 2000


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(nothing, nothing).count() == 0
    out = resample.resample(frame(spark, ROWS), nothing)
    assert by_all(map(tuple, out.collect())) == by_all(plain(ROWS, [], 1, 10_000, 20, 10))
