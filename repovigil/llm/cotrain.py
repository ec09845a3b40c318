"""Quality classification by co-training of two views of a document.

The *text* view sees the words and the character mix, the *metadata* view sees source, language,
length and layout. Each view is a logistic regression. In every round each view labels the unlabelled
documents it is surest of, for the other view to learn from. Afterwards each view is calibrated on
labelled rows kept aside, and a last regression on the two calibrated scores gives one probability.

The text view has a few hundred words as features of their own, and counts of all words that mark a label:
junk and toxic texts have different words, and there may be thousands of each.

Fitting takes a bounded sample: ``SAMPLE_ROWS`` labelled and as many unlabelled documents, the ones
with the smallest hashes of their ids; its features are collected as bits and a few numbers. Scoring
is one pass over all documents with the fitted model, a few hundred numbers, as a broadcast.

A document is good when it is labelled quality 1 and not toxic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repovigil.llm.common import as_bytes, slices
from repovigil.session import written

SAMPLE_ROWS = 12_000
#: Words that are features of their own. Words that mark a label are counted together, however many there are.
WORD_FEATURES = 512
#: A word marks toxic or junk documents if this many labelled ones hold it, at a share this many times the others'.
MARK_DOCS, MARK_RATIO = 3, 20
LABELS = ("toxic", "junk")
#: Words that a task remembers the features of.
CACHED_WORDS = 100_000
LEAST_DOCS = 4
ROUNDS = 3
SURE = 0.98
META_BUCKETS = 48
COLUMNS = ("text", "lang", "source", "n_chars")
#: Byte classes whose shares describe a text.
_CLASSES = [
    bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b".,;:", b"!?", b"|",
    b"#$%&*+/<=>@\\^_`{}~", b"\"'()-[]", b"\n", b" \t", bytes(range(128, 256)),
]
_TEXT_NUMBERS = len(_CLASSES) + 7
_MARK_NUMBERS = 3 * len(LABELS)
_EDGES = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _bare(word: bytes) -> bytes:
    """A word without the signs around it."""
    return word.strip(_EDGES)


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def text_numbers(text: bytes, words: list[bytes], distinct: set[bytes]) -> list[float]:
    size = max(1, len(text))
    shares = [(len(text) - len(text.translate(None, c))) / size for c in _CLASSES]
    lines = text.split(b"\n")
    pairs = len({*zip(words, words[1:])})
    n = max(1, len(words))
    return [
        *shares, math.log1p(len(words)), len(distinct) / n, pairs / n, sum(map(len, words)) / n / 10,
        len({*lines}) / len(lines), sum(w[-1:].isalnum() or w[-1] > 127 for w in distinct) / max(1, len(distinct)),
        max(map(len, distinct), default=0) / 50,
    ]


def meta_features(text: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """One-hot source and language, length as steps and a number, layout."""
    out = np.zeros(META_BUCKETS + 24, np.float32)
    out[xxhash.xxh3_64_intdigest(b"s" + (source or "").encode()) % 40] = 1
    out[40 + xxhash.xxh3_64_intdigest(b"l" + (lang or "").encode()) % 8] = 1
    length = math.log1p(max(0, n_chars if n_chars is not None else 0))
    lines = text.count(b"\n") + 1
    out[META_BUCKETS + min(17, int(length * 1.5))] = 1
    out[META_BUCKETS + 18 :] = (
        length / 10, math.log1p(lines) / 5, math.log1p(len(text) / lines) / 10,
        len(text) / max(1, n_chars or 0, len(text) // 4) - 1, float(n_chars is None), float(not text),
    )
    return out


@dataclass
class Logistic:
    """L2 logistic regression on standardized columns, fitted by full-batch Adam steps."""

    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 250, l2: float = 1e-4) -> Logistic:
        if self.mean is None:
            self.mean = x.mean(0)
            self.scale = 1 / np.maximum(x.std(0), 0.02)
        z = np.c_[(x - self.mean) * self.scale, np.ones(len(x))].astype(np.float32)
        w = np.zeros(z.shape[1], np.float32) if self.weights is None else self.weights
        m, v = np.zeros_like(w), np.zeros_like(w)
        share = (weight / weight.sum()).astype(np.float32)
        penalty = np.r_[np.full(len(w) - 1, l2), 0].astype(np.float32)
        for k in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ ((p - y) * share) + penalty * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.weights = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) * self.scale
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Model:
    """Word features, marking words by label, both views, their calibration and the final combination."""

    words: dict[int, int] = field(default_factory=dict)
    marks: dict[int, int] = field(default_factory=dict)
    text: Logistic | None = None
    meta: Logistic | None = None
    platt: list[tuple[float, float]] = field(default_factory=list)
    combine: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pseudo_labels: tuple[int, int] = (0, 0)

    def probabilities(self, text_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (s * v.logit(x) + t for (s, t), v, x in zip(self.platt, (self.text, self.meta), (text_x, meta_x)))
        wa, wb, c = self.combine
        return _sigmoid(a), _sigmoid(b), _sigmoid(np.clip(wa * a + wb * b + c, -30, 30))


class _Features:
    """Feature rows of documents; word lookups are remembered in a bounded table."""

    def __init__(self, words: dict[int, int], marks: dict[int, int]):
        self.words, self.marks, self.cache = words, marks, {}
        self.plain = (-1, 0)  # one value for nearly all words

    def _place(self, word: bytes) -> tuple[int, int]:
        """The word's own feature, if any, and the labels that it marks, as bits."""
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        found = self.words.get(word_key(word), -1), self.marks.get(word_key(_bare(word)), 0)
        found = self.cache[word] = self.plain if found == self.plain else found
        return found

    def rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Of a batch whose first columns are text, lang, source, n_chars."""
        texts, metas, size = [], [], len(self.words)
        for text, *rest in zip(as_bytes(batch.column(0)), *(batch.column(k).to_pylist() for k in range(1, 4))):
            words = _words(text)
            distinct = {*words}
            row = np.zeros(size + _TEXT_NUMBERS + _MARK_NUMBERS, np.float32)
            row[size : size + _TEXT_NUMBERS] = text_numbers(text, words, distinct)
            get, new = self.cache.get, self._place
            marked: set[tuple[bytes, int]] = set()
            for w in distinct:
                place, mark = get(w) or new(w)
                if place >= 0:
                    row[place] = 1
                if mark:
                    marked.add((_bare(w), mark))
            for k in range(len(LABELS)):
                n = sum(mark >> k & 1 for _, mark in marked)
                row[size + _TEXT_NUMBERS + 3 * k :][:3] = n > 0, n > 1, math.log1p(n)
            texts.append(row)
            metas.append(meta_features(text, *rest))
        return np.array(texts, np.float32), np.array(metas, np.float32)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, lang, source, n_chars, rank, good) of the sampled documents; good is null for unlabelled."""
    chosen = F.xxhash64("doc_id", F.lit("sample"))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality"), F.col("toxic")).where(
        "doc_id is not null and quality is not null"
    )
    toxic, junk = F.max(F.coalesce("toxic", F.lit(0))) != 0, F.min("quality") != 1
    marks = marks.groupBy("doc_id").agg(
        (~toxic & ~junk).cast("int").alias("good"), (toxic.cast("int") + 2 * junk.cast("int")).alias("labels")
    )
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    labelled = ids.join(marks, "doc_id").orderBy(chosen, "doc_id").limit(rows)
    others = ids.join(marks, "doc_id", "left_anti").orderBy(chosen, "doc_id").limit(rows)
    unknown = F.lit(None).cast("int")
    both = labelled.unionByName(others.withColumns({"good": unknown, "labels": unknown}))
    one = docs.join(F.broadcast(both), "doc_id").select(*COLUMNS, "doc_id", "good", "labels")  # 2 * rows ids
    return one.dropDuplicates(["doc_id"]).withColumn("rank", F.xxhash64("doc_id", F.lit("fold")))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 500):
        counts: dict[bytes, list[int]] = {}
        for text, good in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
            for w in {*_words(text)}:
                counts.setdefault(w, [0, 0])[good] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([word_key(w) for w in counts], pa.int64()),
             *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(2))],
            ["word", "bad", "good"],
        )


def _telling_words(sample: DataFrame, features: int) -> dict[int, int]:
    """The words whose share of documents differs most between the classes, as word: place."""
    seen = sample.where("good is not null")
    totals = {r[0]: r[1] for r in seen.groupBy("good").count().collect()}
    if len(totals) < 2:
        return {}
    bad, good = totals[0], totals[1]
    counts = seen.select("text", "good").mapInArrow(_word_counts, "word long, bad long, good long")
    counts = counts.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = (F.col("bad") + F.col("good")) / (bad + good)
    gap = F.abs(F.col("bad") / bad - F.col("good") / good)
    told = counts.where((F.col("bad") + F.col("good")) >= LEAST_DOCS).select(
        "word", (gap / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)))).alias("z")
    )
    top = told.orderBy(F.desc("z"), "word").limit(features).collect()
    return {r[0]: k for k, r in enumerate(top)}


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each combination of labels hold each bare word."""
    for batch in slices(batches, 100):
        counts: dict[bytes, list[int]] = {}
        for text, labels in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
            for w in {_bare(w) for w in _words(text)}:
                counts.setdefault(w, [0, 0, 0, 0])[labels] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([word_key(w) for w in counts], pa.int64()),
             *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(4))],
            ["word", "n0", "n1", "n2", "n3"],
        )


def _marking_words(sample: DataFrame) -> dict[int, int]:
    """Every word that marks a label, as word: bits of the labels.

    All of them: words of the bounded sample that pass ``MARK_DOCS`` and ``MARK_RATIO``.
    """
    seen = sample.where("labels is not null")
    totals = {r[0]: r[1] for r in seen.groupBy("labels").count().collect()}
    counts = seen.select("text", "labels").mapInArrow(_label_counts, "word long, n0 long, n1 long, n2 long, n3 long")
    counts = counts.groupBy("word").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
    bits = F.lit(0)
    for k in range(len(LABELS)):
        inside = [c for c in range(4) if c >> k & 1]
        with_, without = (sum(totals.get(c, 0) for c in range(4) if (c in inside) == own) for own in (True, False))
        if not with_ or not without:
            continue
        here = sum((F.col(f"n{c}") for c in inside), F.lit(0))
        there = sum((F.col(f"n{c}") for c in range(4) if c not in inside), F.lit(0))
        marks = (here >= MARK_DOCS) & (here / with_ >= MARK_RATIO * (there + 0.5) / without)
        bits = bits + F.when(marks, 1 << k).otherwise(0)
    return {r[0]: r[1] for r in counts.select("word", bits.alias("bits")).where("bits > 0").collect()}


def _feature_rows(words: dict[int, int], marks: dict[int, int]):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(words, marks)
        for batch in slices(batches, 200):
            if not batch.num_rows:
                continue
            x, z = features.rows(batch)
            size = len(words)
            bits = np.packbits(x[:, :size].astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.tobytes() for b in bits], pa.binary()),
                 pa.array([r.tobytes() for r in x[:, size:]], pa.binary()),
                 pa.array([r.tobytes() for r in z], pa.binary()), batch.column(4), batch.column(5)],
                ["bits", "numbers", "meta", "good", "rank"],
            )

    return step


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model | None:
    """A model from ``docs`` (doc_id, text, lang, source, n_chars) and ``labels`` (doc_id, quality, toxic).

    None if the labelled documents of the sample are not of both classes.
    """
    # the bounded sample is written once: words and features are those of the same texts
    sample = _sample(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *COLUMNS), labels, sample_rows)
    sample = written(sample, "cotrain-sample")
    words = _telling_words(sample, WORD_FEATURES)
    if not words:
        return None
    marks = _marking_words(sample)
    rows = (
        sample.select(*COLUMNS, "good", "rank")
        .mapInArrow(_feature_rows(words, marks), "bits binary, numbers binary, meta binary, good int, rank long")
        .orderBy("rank")
        .collect()  # at most 2 * sample_rows rows of a few hundred bytes
    )
    bits = np.unpackbits(np.array([np.frombuffer(r[0], np.uint8) for r in rows]), axis=1)[:, : len(words)]
    views = (
        np.c_[bits.astype(np.float32), np.array([np.frombuffer(r[1], np.float32) for r in rows])],
        np.array([np.frombuffer(r[2], np.float32) for r in rows]),
    )
    label = np.array([-1 if r[3] is None else r[3] for r in rows])
    # every fifth labelled row calibrates, the others train
    fold = np.zeros(len(rows), bool)
    fold[np.flatnonzero(label >= 0)[::5]] = True
    return _co_train(words, marks, views, label, fold, rounds)


def _co_train(words, marks, views, label, fold, rounds) -> Model:
    models = (Logistic(), Logistic())
    taught = [np.where(fold, -1, label) for _ in models]  # what each view may learn from
    for k in range(rounds + 1):
        for model, x, y in zip(models, views, taught):
            known = y >= 0
            pseudo = known & (label < 0)
            model.fit(x[known], y[known], np.where(pseudo[known], 0.5, 1.0), steps=250 if not k else 60)
        if k == rounds:
            break
        for own, other in ((0, 1), (1, 0)):
            p = _sigmoid(models[own].logit(views[own]))
            # confident only where its own calibration rows bear it out
            for value, sure in ((1, p > SURE), (0, p < 1 - SURE)):
                shown = sure & fold
                if shown.sum() >= 5 and (label[shown] == value).mean() >= 0.95:
                    taught[other][sure & (taught[other] < 0) & (label < 0)] = value
    added = tuple(int(((t >= 0) & (label < 0)).sum()) for t in taught)
    y = label[fold].astype(np.float32)
    one = np.ones(len(y), np.float32)
    platt, logits = [], []
    for model, x in zip(models, views):
        raw = model.logit(x[fold])[:, None]
        s, t = _line(raw, y, one)
        platt.append((float(s[0]), t))
        logits.append(raw[:, 0] * s[0] + t)
    w, c = _line(np.stack(logits, 1), y, one)
    return Model(words, marks, *models, platt, (float(w[0]), float(w[1]), c), added)


def _line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, not negative, and offset of a logistic regression on a few columns."""
    m = Logistic().fit(x, y, weight, steps=400, l2=1e-3)
    slope = np.maximum(m.weights[:-1] * m.scale, 0)
    return slope, float(m.weights[-1] - (m.mean * slope).sum())


def _apply(shared, columns: list[str], only_kept: bool, threshold: float):
    """``columns`` of a batch whose last four are text, lang, source, n_chars, and the scores."""
    n = len(columns)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        features = _Features(model.words, model.marks) if model else None
        for batch in slices(batches, 500):
            rows = batch.num_rows
            if not rows:
                continue
            if model is None:
                scores = [pa.nulls(rows, pa.float64())] * 3
                keep = np.ones(rows, bool)
            else:
                view = batch.select([*range(n, n + 4)])
                p = model.probabilities(*features.rows(view))
                scores = [pa.array(x.astype(float)) for x in p]
                keep = p[2] >= threshold
            out = [batch.column(k) for k in range(n)]
            if only_kept:
                made = pa.RecordBatch.from_arrays(out, columns)
                yield made.take(pa.array(np.flatnonzero(keep)))
            else:
                yield pa.RecordBatch.from_arrays(
                    [*out, *scores, pa.array(keep)], [*columns, "text_score", "meta_score", "score", "keep"]
                )

    return step


def _inputs(docs: DataFrame, columns: list[str]) -> DataFrame:
    kinds = {"n_chars": "bigint"}
    view = [F.col(c).cast(kinds.get(c, "string")).alias(f"view_{c}") for c in COLUMNS]
    return docs.select(*[F.col(c).alias(f"own{k}") for k, c in enumerate(columns)], *view)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) for every row: probabilities of being good.

    Null columns count as unknown source or language, no length, empty text. Without a model the
    scores are null and every row is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _inputs(docs, ["doc_id"]).mapInArrow(
        _apply(shared, ["doc_id"], False, threshold),
        "doc_id long, text_score double, meta_score double, score double, keep boolean",
    )


def keep_good(docs: DataFrame, model: Model | None, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """``columns`` of the rows that ``score`` keeps, in the same pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return _inputs(docs, columns).mapInArrow(_apply(shared, columns, True, threshold), schema)
