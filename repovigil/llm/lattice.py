"""Language-model scores from a subword lattice.

The vocabulary of an existing tokenizer is the set of arcs: every way to cut a word into its pieces is
a path, and the probability of a word is the sum over all paths of the products of the piece
probabilities. A forward recursion in log space adds the paths up. Words begin with the vocabulary's
word mark and no piece goes on past one, so the lattice of a text is the chain of its words' lattices,
closed by an end symbol.

The vocabulary's own scores give the first weights: the scores of its merge list are ranks, so a piece of
rank r starts at a weight of 1 / (r + 2). They are then fitted to the words of the training documents by
expectation maximization: the expected use of each piece over all paths of all distinct words is its next
weight. The vocabulary is never changed.

One more arc spans the whole of a word (or the end) that the training documents hold, with the share of
the word in all their tokens. The arcs of pieces together weigh what the training documents leave to
unseen words, the share of words seen once, so all token probabilities sum to one.

Every distinct word of the documents is one row of a table, with its count in the training documents and the
log probability of its lattice, computed once. The most frequent ones, at most ``TOP_WORDS``, are
broadcast; the rarer words of a document are looked up in the table by a join of word hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repovigil.llm.common import as_bytes, id_text, slices, words_of
from repovigil.session import written

TOP_WORDS = 200_000
EM_ROUNDS = 1
SMOOTHING = 0.1
_FLUSH = 300_000
_MARK = "▁"
_LN10 = math.log(10)
END = -1


def read_pieces(path: str) -> dict[str, float]:
    """Pieces and natural-log start weights of a SentencePiece vocabulary; bytes as ``<0xNN>``.

    Control pieces, unused ones and those with a word mark after the first place are left out.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[str, float] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or _MARK in piece[1:]:
            continue
        score = model.get_score(i)
        found[piece] = -math.log(2 - score) if -1e8 < score <= 0 else -math.log(2e9)
    total = math.log(math.fsum(map(math.exp, found.values())))
    return {p: w - total for p, w in found.items()}


class Lattice:
    """Natural-log weights of pieces, as a trie of characters."""

    def __init__(self, weights: dict[str, float], end: float = 0.0):
        self.names = [*weights]
        self.end = end
        self.trie: dict = {}
        self.bytes: dict[int, tuple[int, float]] = {}
        self.log = [*weights.values()]
        for k, piece in enumerate(self.names):
            if len(piece) == 6 and piece.startswith("<0x"):
                self.bytes[int(piece[3:5], 16)] = (k, self.log[k])
                continue
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[0] = (k, self.log[k])

    def arcs(self, word: str) -> Iterator[tuple[int, int, float, tuple[int, ...]]]:
        """(from, to, weight, pieces) in order of the start; a character that is no piece goes by bytes."""
        trie, n = self.trie, len(word)
        for p in range(n):
            node, q, alone = trie, p, False
            while q < n:
                node = node.get(word[q])
                if node is None:
                    break
                q += 1
                own = node.get(0)
                if own is not None:
                    alone |= q == p + 1
                    yield p, q, own[1], own[:1]
            if not alone:
                own = [self.bytes[b] for b in word[p].encode()]
                yield p, p + 1, math.fsum(w for _, w in own), tuple(k for k, _ in own)

    def log_probability(self, word: str) -> float:
        """Log of the sum over all segmentations of ``word``, which starts with the word mark."""
        reach: list[list[float]] = [[] for _ in range(len(word) + 1)]
        reach[0].append(0.0)
        at, here = 0, 0.0
        for p, q, w, _ in self.arcs(word):
            if p != at:
                at, here = p, _log_sum(reach[p])
            reach[q].append(here + w)
        return _log_sum(reach[-1])

    def expected(self, word: str, count: float, into: list[float]) -> float:
        """Add the expected uses of each piece in ``count`` such words; returns the log probability."""
        arcs = [*self.arcs(word)]
        n = len(word)
        reach: list[list[float]] = [[] for _ in range(n + 1)]
        reach[0].append(0.0)
        front = [0.0] * (n + 1)
        at = 0
        for p, q, w, _ in arcs:
            if p != at:
                at, front[p] = p, _log_sum(reach[p])
            reach[q].append(front[p] + w)
        total = front[n] = _log_sum(reach[n])
        onward: list[list[float]] = [[] for _ in range(n + 1)]
        back = [0.0] * (n + 1)
        at = n
        for p, q, w, pieces in reversed(arcs):
            if p != at:
                at = p
            if q != n and not back[q]:
                back[q] = _log_sum(onward[q])
            x = w + back[q]
            onward[p].append(x)
            share = count * math.exp(front[p] + x - total)
            for k in pieces:
                into[k] += share
        return total


def _log_sum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    top = max(values)
    if top == -math.inf:
        return top
    return top + math.log(math.fsum([math.exp(v - top) for v in values]))


def is_held_out(doc_id: Column) -> Column:
    """Every tenth document by the checksum of its id; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, training count) of a task, in portions; the empty word counts the ends of documents."""
    counts: Counter = Counter()
    others: set[bytes] = set()

    def portion():
        new = [w for w in others if w not in counts]
        return pa.RecordBatch.from_arrays(
            [pa.array([*counts, *new], pa.binary()).cast(pa.string()), pa.array([*counts.values()] + [0] * len(new), pa.int64())],
            ["word", "count"],
        )

    for batch in slices(batches, 500):
        for text, held_out in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            if held_out:
                others.update(words_of(text))
            else:
                counts.update(words_of(text))
                counts[b""] += 1
        if len(counts) + len(others) >= _FLUSH:
            yield portion()
            counts.clear()
            others.clear()
    yield portion()


def _by_pieces(shared):
    """Adds to rows (word, count) the natural log of the word's probability by pieces alone."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice: Lattice = shared.value
        for batch in batches:
            logs = [lattice.log_probability(_MARK + w) if w else 0.0 for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(logs, pa.float64())], ["word", "count", "pieces"]
            )

    return step


def _expect(shared):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice: Lattice = shared.value
        uses = [0.0] * len(lattice.names)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                if word:
                    lattice.expected(_MARK + word, 1.0, uses)
        found = [(k, u) for k, u in enumerate(uses) if u]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.float64())],
            ["piece", "uses"],
        )

    return step


def fit_lattice(counts: DataFrame, pieces: dict[str, float], rounds: int = EM_ROUNDS) -> Lattice:
    """A lattice fitted to the distinct words of ``counts`` (word); the empty word is not one.

    The pieces and the end symbol share one distribution with ``SMOOTHING`` added to each use.
    """
    spark = counts.sparkSession
    lattice = Lattice(pieces, math.log(SMOOTHING))
    for _ in range(rounds):
        step = _expect(spark.sparkContext.broadcast(lattice))
        narrow = counts.select("word").mapInArrow(step, "piece int, uses double")
        uses = {r[0]: r[1] for r in narrow.groupBy("piece").agg(F.sum("uses")).collect()}  # the vocabulary at most
        total = math.log(math.fsum(uses.values()) + SMOOTHING * (len(pieces) + 1))
        weights = {p: math.log(uses.get(k, 0.0) + SMOOTHING) - total for k, p in enumerate(lattice.names)}
        # where a word may begin there is a first piece or the end
        first = math.fsum(math.exp(w) for p, w in weights.items() if p.startswith(_MARK))
        end = math.exp(math.log(SMOOTHING) - total)
        lattice = Lattice(weights, math.log(end / (first + end)))
    return lattice


def _hash(word: bytes) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


_SCORED = (
    "doc_id long, digest binary, n_tokens long, n_known long, base double, score double, tail_hash array<long>, "
    "tail_times array<int>"
)


def _score(shared):
    """Scores of the end and the frequent words; hashes and times of the rarer ones."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, end = shared.value
        for batch in slices(batches, 500):
            rows = []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                base, n_known, score = end
                hashes, times = [], []
                for w, n in Counter(words).items():
                    entry = top.get(w)
                    if entry is None:
                        hashes.append(_hash(w))
                        times.append(n)
                    else:
                        n_known += n
                        base += n * entry[0]
                        score += n * entry[1]
                rows.append((hashlib.md5(text).digest(), len(words) + 1, n_known, base, score, hashes, times))
            columns = [*zip(*rows)] or [()] * 7
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                ["doc_id", "digest", "n_tokens", "n_known", "base", "score", "tail_hash", "tail_times"],
            )

    return step


def score(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    top_words: int = TOP_WORDS,
    rounds: int = EM_ROUNDS,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    ``vocabulary`` is a SentencePiece file, present on every executor. ``score`` is the log10 marginal
    probability of the text under the lattice, ``base_score`` that under smoothed counts of whole words.
    Tokens are words and one end per text; a null or empty text is its end alone. Repeated rows count as
    often as they are there. Words are joined by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    marked = rows.withColumn("held_out", is_held_out(F.col("doc_id")))
    counts = marked.mapInArrow(_count_words, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))
    counts = written(counts, "word-counts")
    is_end = F.col("word") == ""
    total, distinct, ends, once = counts.where("count > 0").agg(
        F.coalesce(F.sum("count"), F.lit(0)),
        F.count("*"),
        F.coalesce(F.sum(F.when(is_end, F.col("count"))), F.lit(0)),
        F.count(F.when(~is_end & (F.col("count") == 1), 1)),
    ).first()
    unseen = (once + 1) / (total + 1)
    lattice = fit_lattice(counts.where("count > 0"), read_pieces(vocabulary), rounds)
    fitted = spark.sparkContext.broadcast(lattice)
    words = counts.mapInArrow(_by_pieces(fitted), "word string, count long, pieces double")
    words = written(words.withColumn("hash", F.xxhash64("word")), "word-scores")
    scale = total + 0.1 * (distinct + 1)

    # the counts from which on at most top_words words remain; one row for each count that occurs
    least, so_far = None, 0
    sizes = words.where("count > 0").groupBy("count").agg(F.count("*").alias("words"))
    for n, size in sizes.orderBy(F.desc("count")).limit(top_words).collect():
        so_far += size
        if so_far > top_words:
            break
        least = n
    frequent = []
    if least is not None:
        frequent = words.where(F.col("count") >= least).where(~is_end).select("word", "count", "pieces").collect()
    whole = lambda n: math.log((1 - unseen) * n / total) if n and unseen < 1 else -math.inf
    both = lambda n, pieces: _log_sum([whole(n), math.log(unseen) + pieces]) / _LN10
    top = {r[0].encode(): (math.log10((r[1] + 0.1) / scale), both(r[1], r[2])) for r in frequent}
    end = (math.log10((ends + 0.1) / scale), int(ends > 0), both(ends, lattice.end))

    shared = spark.sparkContext.broadcast((top, end))
    scored = written(rows.mapInArrow(_score(shared), _SCORED), "lm-scores")
    # rarer words, once for each text
    tails = scored.where(F.size("tail_hash") > 0).select("digest", "tail_hash", "tail_times")
    tails = tails.dropDuplicates(["digest"]).select("digest", F.explode(F.arrays_zip("tail_hash", "tail_times")).alias("t"))
    tails = tails.select("digest", F.col("t.tail_hash").alias("hash"), F.col("t.tail_times").alias("times"))
    looked = tails.join(words.select("hash", "count", "pieces"), "hash")
    by_pieces = F.col("pieces") / _LN10 + math.log10(unseen)
    own_arc = (1 - unseen) * F.col("count") / float(max(total, 1))
    summed = F.when(F.col("count") == 0, by_pieces).otherwise(F.log10(own_arc + F.pow(F.lit(10.0), by_pieces)))
    sums = looked.groupBy("digest").agg(
        F.sum(F.col("times") * F.log10((F.col("count") + 0.1) / scale)).alias("tail_base"),
        F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("times") * summed).alias("tail_score"),
    )
    return scored.join(sums, "digest", "left").select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("tail_score", F.lit(0.0))).alias("score"),
    )
