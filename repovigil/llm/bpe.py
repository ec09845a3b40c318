"""BPE encoding and decoding with an automaton compiled from the merge list.

Merge gadgets
    The automaton starts as one state with an arc for every base symbol. A merge (u, v) -> w of rank
    r applies one gadget: the state behind u is split off from those who share it and loses its arc
    v; the new symbol w can be read wherever u can and leads where v led. After the last merge the
    automaton accepts exactly the segmentations that the merges produce, one for every string, so a
    token may follow another iff its arc survived.

    The state behind w is the state behind v as it was at rank r, so it is kept as that reference and
    the arcs it loses itself; w may be read where u could at rank r, so an arc lost at u later than r
    does not concern it. A merge whose u can no longer be followed by v adds nothing.

Encoding
    A word is read through the trie of token strings. For every prefix exactly one token ends the
    valid segmentation; it is found by following arcs that survived, from tables of (token before,
    token) pairs that fill as they are used. Decoding emits the labels of the arcs.

No data is shuffled. The compiled automaton depends on the vocabulary alone and is loaded once per
Python worker; words seen are remembered in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repovigil.llm.common import id_text, slices

CACHE_WORDS = 250_000
CACHE_CHARS = 64
_NEVER = 1 << 60
#: str.split also splits at these four, which are not white space in Unicode.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others are numbered from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class MergeAutomaton:
    """States, removed arcs and the trie of a merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.label = {i: t for t, i in vocab.items()}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + end] for s in symbols]
        base = [*self.inner, *self.final]
        self.lost: dict[int, dict[int, int]] = {}  # arcs that the state behind a symbol lost, and when
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        spelled: dict[int, tuple[int, ...]] = {s: (s,) for s in base}
        for r, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u in spelled and v in spelled and w not in spelled and self.may_follow(v, u):
                self._gadget(r, u, v, w)
                spelled[w] = spelled[u] + spelled[v]
        self.trie: dict = {}
        for token, path in spelled.items():
            node = self.trie
            for s in path:
                node = node.setdefault(s, {})
            node[-1] = token
        self.follows: dict[int, bool] = {}

    def _gadget(self, r: int, u: int, v: int, w: int) -> None:
        self.lost.setdefault(u, {})[v] = r
        self.left[w], self.right[w], self.born[w] = u, v, r

    def may_follow(self, token: int, after: int) -> bool:
        """Does the state behind ``after`` still have an arc for ``token``?"""
        state, before = after, _NEVER
        while True:
            lost = self.lost.get(state)
            if lost:
                arc, until = token, _NEVER
                while True:
                    r = lost.get(arc)
                    if r is not None and r < before and r <= until:
                        return False
                    if arc not in self.left:
                        break
                    until, arc = self.born[arc], self.left[arc]
            if state not in self.right:
                return True
            before, state = self.born[state], self.right[state]

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word, by table-driven transitions.

        From each position the arcs are tried longest first. A position that no arc leads on from is
        never entered again: the token that ends there is the same for every way to reach it.
        """
        n = len(word)
        path = [self.inner[b] for b in word[:-1]]
        path.append(self.final[word[-1]])
        follows, trie = self.follows, self.trie
        dead: set[int] = set()
        out: list[int] = []
        arcs: list[list[tuple[int, int]]] = []
        starts: list[int] = []
        p = 0
        while True:
            node, q, found = trie, p, []
            while q < n:
                node = node.get(path[q])
                if node is None:
                    break
                q += 1
                token = node.get(-1)
                if token is not None:
                    found.append((token, q))
            arcs.append(found)
            # the longest arc that survived; steps back where none is left
            while True:
                options = arcs[-1]
                before = out[-1] if out else -1
                step = 0
                while options:
                    token, q = options.pop()
                    if q in dead:
                        continue
                    if before >= 0:
                        key = before << 20 | token
                        ok = follows.get(key)
                        if ok is None:
                            if len(follows) > 1_000_000:
                                follows.clear()
                            ok = follows[key] = self.may_follow(token, before)
                        if not ok:
                            continue
                    step = q
                    break
                if step:
                    out.append(token)
                    starts.append(p)
                    break
                dead.add(p)
                arcs.pop()
                out.pop()
                p = starts.pop()
            p = step
            if p == n:
                return out

    def decode(self, ids: list[int]) -> list[str]:
        return [self.label[i] for i in ids]


class WordBpe:
    """Encoder of a tokenizer file with word ends: NFC, lower case, split, merge automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton.label.update({i: t for t, i in self.special.items()})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.known: dict[str, list[int]] = {}
        self.cache = _Chunks(self)

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space."""
        out: list[int] = []
        for part in self.cut.split(chunk) if "<|" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
                continue
            # lower case of each character alone: a final sigma is no special case
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for word in self.pattern.findall(plain):
                ids = self.known.get(word)
                if ids is None:
                    if len(self.known) >= CACHE_WORDS:
                        self.known.clear()
                    ids = self.automaton.encode(word.encode())
                    if len(word) <= CACHE_CHARS:
                        self.known[word] = ids
                out += ids
        return out

    def ids(self, text: str) -> list[int]:
        return [i for c in self._chunks(text) for i in self.chunk(c)]

    def _chunks(self, text: str) -> list[str]:
        if _NOT_SPACE.search(text):
            return [c for c in _SPACE_RUN.split(text) if c]
        return text.split()

    def encoded(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids joined by a space, decoded text."""
        cache = self.cache
        cache.bound()
        found = [cache[c] for c in self._chunks(text)]
        ids = " ".join([e[0] for e in found])
        return ids.count(" ") + bool(ids), ids, " ".join([e[1] for e in found])


class _Chunks(dict):
    """Ids and labels, each joined by a space, of chunks without white space; every chunk has a token."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def bound(self) -> None:
        if len(self) >= CACHE_WORDS:
            self.clear()

    def __missing__(self, chunk: str) -> tuple[str, str]:
        ids = self.bpe.chunk(chunk)
        entry = (" ".join(map(str, ids)), " ".join(self.bpe.automaton.decode(ids)))
        if len(chunk) <= CACHE_CHARS:
            self[chunk] = entry
        return entry


_LOADED: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """The compiled tokenizer of this process; built once."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string), one row per row of ``docs``; null text as empty.

    ``path`` is the tokenizer file, present at the same place on every executor.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in slices(batches, 500):
            done = [bpe.encoded(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[*map(int, d[1].split())] for d in done], pa.list_(pa.int32())),
                 pa.array([d[2] for d in done], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(step, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded string) from id lists; null ids as none, unknown ids are skipped."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = encoder(path).automaton.label
        for batch in slices(batches, 500):
            texts = [" ".join(label[i] for i in ids or () if i in label) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    narrow = encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return narrow.mapInArrow(step, "doc_id long, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode`` in the same pass as its digests."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in slices(batches):
            counts, ids, texts = [], [], []
            for text in batch.column(1).to_pylist():
                n, joined, decoded = bpe.encoded(text or "")
                counts.append(n)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(
        step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
