"""The operators against plain versions, on hand-made rows and small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import connect, differences
from conftest import SF
from fixtures import documents, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repovigil.llm import bpe, components, cotrain, decontaminate, extract, jaccard, lattice, lines, queries, shards, topk
from repovigil.llm.common import word_hashes
from repovigil.llm.mphf import CountIndex

ROWS = documents()
by_all = lambda rows: sorted(rows, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.SQL[name], connect(SF)) is None


# sharding


def test_shards(docs):
    out = [r.asDict() for r in shards.assign_shards(docs).collect()]
    assert len(out) == len(ROWS)
    size = lambda t: len((t or "").encode()) + 1
    expected = [(d, size(t), zlib.crc32((t or "").encode())) for d, t in ROWS]
    assert by_all((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == by_all(expected)
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for s in range(8):
        assert abs(sum(r["size"] for r in out if r["shard"] == s) - total / 8) <= largest + 0.02 * total / 8


def test_shards_split_one_group_evenly(spark):
    """All rows alike, ids and all: the group is cut into equal shards."""
    df = spark.range(0, 4000, 1, 6).select(F.lit(1).alias("doc_id"), F.lit("same text").alias("text"))
    counts = {r[0]: r[1] for r in shards.assign_shards(df).groupBy("shard").count().collect()}
    assert counts == {s: 500 for s in range(8)}


def test_shards_keep_small_groups_together():
    rows = [("SHARD", 1)]
    assert shards.Splitters([(1, 2, 3)]).ranges(*(np.array([v]) for v in (1, 2, 3)))[0] == 1
    r = random.Random(1)
    keys = [tuple(r.randint(0, 3) for _ in range(3)) for _ in range(40)]
    rows = [tuple(r.randint(0, 3) for _ in range(3)) for _ in range(300)]
    s = shards.Splitters(keys)
    got = s.ranges(*(np.array([x[c] for x in rows]) for c in range(3)))
    assert got.tolist() == [sum(k <= x for k in s.keys) for x in rows]


def test_shards_files(spark, docs, tmp_path):
    shards.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert by_all((r["doc_id"], r["text"]) for r in back.collect()) == by_all((d, t) for d, t in ROWS if d is not None or t is not None or True)
    assert {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_shards_of_nothing(nothing):
    out = shards.assign_shards(nothing)
    assert out.count() == 0 and "slot" in out.columns


# tokens


def test_bpe_equals_the_library(docs):
    t = Tokenizer.from_file(queries.WORD_BPE)
    ids = [t.encode(x or "", add_special_tokens=False).ids for _, x in ROWS]
    decoded = [t.decode(i, skip_special_tokens=False) for i in ids]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(d, len(i), sha(" ".join(map(str, i))), sha(s)) for (d, _), i, s in zip(ROWS, ids, decoded)]
    assert by_all(map(tuple, bpe.digests(docs, queries.WORD_BPE).collect())) == by_all(expected)
    both = bpe.encode(docs, queries.WORD_BPE)
    assert by_all((r[0], r[1], r[2]) for r in both.collect()) == by_all((d, i, s) for (d, _), i, s in zip(ROWS, ids, decoded))
    again = bpe.decode(both, queries.WORD_BPE)
    assert by_all(map(tuple, again.collect())) == by_all((d, s) for (d, _), s in zip(ROWS, decoded))


def test_bpe_random_texts():
    t, own, r = Tokenizer.from_file(queries.WORD_BPE), bpe.encoder(queries.WORD_BPE), random.Random(2)
    alphabet = "aabbcdeefhinnorrsttt's.!<|>é漢́ΣİǅÅ½٣\x1c\x85\xa0\n 0"
    for _ in range(1500):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 200)))
        assert own.ids(s) == t.encode(s, add_special_tokens=False).ids


def test_merge_gadgets_accept_what_merges_produce():
    """A small alphabet with many merges: the automaton against merging by rank."""
    r = random.Random(4)
    symbols = bpe.byte_symbols()
    vocab = {}
    for s in [*symbols, *(s + "/" for s in symbols)]:
        vocab[s] = len(vocab)
    merges, tokens = [], ["a", "b", "a/", "b/"]
    while len(merges) < 60:
        u, v = r.choice([t for t in tokens if "/" not in t]), r.choice(tokens)
        if u + v not in vocab and len(u + v) < 12:
            vocab[u + v] = len(vocab)
            merges.append((u, v))
            tokens.append(u + v)
    rank = {m: k for k, m in enumerate(merges)}
    automaton = bpe.MergeAutomaton(vocab, merges, "/")
    for _ in range(3000):
        word = "".join(r.choice("ab") for _ in range(r.randint(1, 25)))
        parts = [*word[:-1], word[-1] + "/"]
        while True:
            found = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank]
            if not found:
                break
            _, k = min(found)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert automaton.decode(automaton.encode(word.encode())) == parts


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>%s</body></html>"""


@pytest.mark.parametrize(
    "body, text",
    [
        ("<nav><a>Home</a></nav><article><h1>A &amp; B</h1><p>First\n\t one.<p>Sec<b>ond</b>&nbsp;two</p></article><footer>c</footer>", "A & B First one. Second two"),
        ("<div class='ad'>Buy</div><main><p>Body of the page.</p><aside>x</aside><form>y</form></main>", "Body of the page."),
        ("<article><header><h1>H</h1><p>by me</p></header><p>Text.</p><section id=comments><p>me too</p></section></article>", "H Text."),
        ("<article><p>one<br>two</p><ul><li>a</li><li>b</li></ul><!-- no --></article>", "one two a b"),
        ("<div class=cookie-notice>We use cookies</div><article><p>x</p></article>", "x"),
        ("<article></article>", ""),
        ("", ""),
    ],
)
def test_main_text(body, text):
    assert extract.main_text(PAGE % body) == text


def test_main_text_without_article():
    long = "Many words of a paragraph that goes on and on, "
    page = (
        "<body class='has-sidebar'><div id=top><a href=/>Home</a> <a href=/a>About us</a></div><div class='with-sidebar'>"
        f"<div><h2>Title</h2><p>{long * 3}</p><p>Short.</p><p>{long * 2}</p></div></div>"
        f"<div class=sidebar><p>{long}</p></div><div id=comments><p>{long}</p></div>"
    )
    assert extract.main_text(page) == " ".join(f"Title {long * 3} Short. {long * 2}".split())


def test_extract_rows(spark):
    rows = [(1, "u", "<article>a</article>"), (None, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<![x <p>a" + "b" * 90_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    out = by_all(map(tuple, extract.extract(df).collect()))
    assert out == by_all([(1, "u", "a", 1), (None, None, "", 0), (2, "u", "", 0), (2, "u", "", 0), (3, "u", "<![x a" + "b" * 90_000, 90_006)])


def test_extract_table(spark):
    """Pages of the small table: the article element's text."""
    import html as H
    import re

    for page in pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist():
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        plain = re.sub(r"<(?!/?b>)[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")
        assert extract.main_text(page) == " ".join(H.unescape(plain).split())


# classifier


def labelled(spark, seed, n):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        kind = r.choice("gggbt")
        words = [r.choice(["stone", "river", "light", "under", "and", "the", "of", "walks"]) + r.choice(["", "s", "ly"]) for _ in range(r.randint(20, 80))]
        if kind == "b":
            words = [w.upper() + "!!" for w in words]
        if kind == "t":
            words[r.randrange(len(words))] = r.choice(["nasty", "vile"])
        docs.append((i, " ".join(words), "en", f"s{'x' if kind == 'b' and r.random() < 0.8 else r.randint(0, 3)}", sum(map(len, words))))
        labels.append((i, int(kind != "b"), int(kind == "t")))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_held_out(spark):
    docs, labels = labelled(spark, 1, 1500)
    model = cotrain.fit(docs, labels.where("doc_id < 700"))
    assert max(model.pseudo_labels) > 100  # the views did teach each other
    out = cotrain.score(docs, model).join(labels, "doc_id").where("doc_id >= 700").collect()
    right = [r["keep"] == (r["quality"] == 1 and r["toxic"] == 0) for r in out]
    assert len(out) == 800 and sum(right) / len(right) > 0.97
    meta = [(r["meta_score"], r["quality"]) for r in out]
    mean = lambda q: np.mean([m for m, x in meta if x == q])
    assert mean(1) > mean(0) + 0.2
    kept = cotrain.keep_good(docs, model, docs.columns)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in cotrain.score(docs, model).where("keep").collect()}


def test_every_marking_word_counts(spark):
    """Far more toxic words than there are word features, each in three labelled documents."""
    r = random.Random(6)
    plain = [f"{a}{b}" for a in ("stone", "river", "light", "under") for b in ("", "s", "ly", "ing")]
    bad = [f"ugly{k}" for k in range(600)]
    rows, labels = [], []
    for i in range(6000):
        words = [r.choice(plain) for _ in range(30)]
        if i < 5400 and i % 9 == 0:
            words[5] = bad[i // 9] + ","
            words[9] = bad[(i // 9 + 1) % 600].upper() + "!"
            words[11] = bad[(i // 9 + 2) % 600]
        elif i >= 5400 and i % 9 == 0:
            words[7], words[8] = r.sample(bad, 2)
        rows.append((i, " ".join(words), "en", "s", 200))
        labels.append((i, 1, int(i % 9 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = cotrain.fit(docs, marks.where("doc_id < 5400"))
    assert {k for k, v in model.marks.items() if v == 1} == {cotrain.word_key(w.encode()) for w in bad}
    out = cotrain.score(docs, model).where("doc_id >= 5400").collect()
    assert np.mean([r["keep"] == (r["doc_id"] % 9 != 0) for r in out]) > 0.99


def test_classifier_edges(spark):
    docs, labels = labelled(spark, 2, 300)
    model = cotrain.fit(docs, labels)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "", "", -5), (1, "", "", "", -5), (2, "x " * 50_000, "??", None, 10**12)], docs.schema
    )
    assert cotrain.score(odd, model).count() == 4 and cotrain.score(docs.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.where("quality = 1 and toxic = 0"), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert cotrain.fit(docs, none) is None
    assert {(r["score"], r["keep"]) for r in cotrain.score(docs, None).collect()} == {(None, True)}
    assert cotrain.fit(docs.limit(0), labels) is None


# lines


@pytest.mark.parametrize("min_docs, copies", [(10, True), (2, True), (10, False), (3, False)])
def test_lines(docs, min_docs, copies):
    out = lines.drop_frequent_lines(docs, min_docs=min_docs, keep=("digest",), count_copies=copies)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()]
    assert by_all(got) == by_all(brute.frequent_lines_dropped(ROWS, min_docs, copies))
    assert out.columns[-1] == "digest"


def test_lines_of_nothing(nothing):
    assert lines.drop_frequent_lines(nothing).count() == 0


def test_count_index():
    r = np.random.RandomState(1)
    keys = np.unique(r.randint(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    counts = r.randint(0, 70_000, len(keys))
    index = CountIndex.loads(CountIndex.build(keys, counts).dumps())
    assert sorted(index.places(keys).tolist()) == list(range(len(keys)))
    assert (index.lookup(keys) == np.minimum(counts, 65535)).all()
    strange = index.lookup(keys ^ np.uint64(1 << 40))
    assert (strange > 0).mean() < 0.01
    assert len(CountIndex.loads(CountIndex.build(keys[:0], counts[:0]).dumps()).lookup(keys)) == len(keys)


# Jaccard join


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard(docs, words, percent):
    out = jaccard.link_components(docs, words, percent).select("doc_id", "n_shingles", "component_id")
    assert by_all(map(tuple, out.collect())) == by_all(brute.jaccard_components(ROWS, words, percent))


def test_jaccard_small_sets(spark):
    """Sets of a few frequent words, where the light side finds the links."""
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abcdefghijkl") for _ in range(r.randint(1, 22)))) for i in range(500)]
    out = jaccard.link_components(frame(spark, rows), 1, 85).select("doc_id", "n_shingles", "component_id")
    assert by_all(map(tuple, out.collect())) == by_all(brute.jaccard_components(rows, 1, 85))


def test_jaccard_long_lists_in_blocks(spark, monkeypatch):
    """Many near copies, most of them linked only through others, in blocks of a few rows."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    r = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 500)}"
        rows.append((i, " ".join(w)))
    for percent in (75, 85):
        out = jaccard.link_components(frame(spark, rows), 3, percent).select("doc_id", "n_shingles", "component_id")
        expected = brute.jaccard_components(rows, 3, percent)
        assert by_all(map(tuple, out.collect())) == by_all(expected)
        assert 1 < len({c for _, _, c in expected}) < 160


def test_jaccard_lists_of_three(spark):
    """Of each three sets, a linked pair shares one key alone, whose list holds the third set too."""
    rows = []
    for g in range(60):
        both = [f"b{g}-{i}" for i in range(36)]
        third = both + [f"common{i}" for i in range(20)]
        rows += [(3 * g, " ".join(both + [f"own{g}-{i}" for i in range(9)])), (3 * g + 1, " ".join(both)), (3 * g + 2, " ".join(third))]
    out = jaccard.link_components(frame(spark, rows), 1, 80).select("doc_id", "n_shingles", "component_id")
    assert by_all(map(tuple, out.collect())) == by_all(brute.jaccard_components(rows, 1, 80))


def test_jaccard_lists_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_ROWS", 1)
    rows = []
    for g in range(40):
        words = [f"w{g}-{i}" for i in range(90)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words, "one", f"more{g}"]))]
    out = jaccard.link_components(frame(spark, rows), 3, 80).select("doc_id", "n_shingles", "component_id")
    assert by_all(map(tuple, out.collect())) == by_all(brute.jaccard_components(rows, 3, 80))


def test_shapes_never_part_linked_sets():
    r = np.random.RandomState(2)
    for size in (1, 5, 60, 3000, 40_000):
        one = np.unique(r.randint(0, 2**62, size).astype(np.uint64))
        two = np.unique(np.r_[one[len(one) // 20 :], r.randint(0, 2**62, size // 30 + 1).astype(np.uint64)])
        both = len(np.intersect1d(one, two))
        percent = 100 * both // (len(one) + len(two) - both)
        x, y = (np.frombuffer(jaccard.shape(s), np.uint8).astype(int) for s in (one, two))
        assert np.abs(x - y).sum() <= (len(one) + len(two)) * (100 - percent) // (100 + percent)


def test_jaccard_keeps_one(docs):
    kept = [r[0] for r in jaccard.keep_one(docs, ["doc_id", "text"], 5, 80).collect()]
    groups = {}
    for doc, n, component in brute.jaccard_components(ROWS, 5, 80):
        if n:
            groups.setdefault(component, set()).add(doc)
    wordless = [d for d, t in ROWS if not (t or "").strip(brute.SPACE)]
    assert by_all(kept) == by_all([*groups, *wordless])


def test_boundary_by_cost():
    assert jaccard.choose_light({}, 90, 5.0) == 0
    cheap, dear = (jaccard.choose_light({8: 1000, 12: 1000, 200: 10}, 90, x) for x in (0.0, 500.0))
    assert cheap < dear >= 12
    assert jaccard.subset_sizes(9, 90) == [9] and jaccard.subset_sizes(10, 90) == [9, 10]


def test_lists_of_one_go():
    rows = [(1, 0, 5, 2), (1, 0, 5, 2), (2, 0, 5, 2), (2, 0, 6, 2), (2, 0, 6, 2), (2, 0, 7, 2), (3, 1, 4, 2), (4, 0, 1, 2), (5, 0, 1, 2), (5, 0, 2, 2)]
    for cut in range(1, len(rows)):
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32()))], list("kspn"))
            for part in (rows[k : k + cut] for k in range(0, len(rows), cut))
        ]
        got = [(k, s) for b in jaccard._shared_only(iter(batches)) for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert sorted(got) == [(2, 5), (2, 6), (2, 7), (3, 4), (5, 1), (5, 2)], cut


def test_words_are_hashed_alike_everywhere():
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "B", "longer", "été", "x" * 30]) for _ in range(r.randint(0, 50))).encode() for _ in range(50)]
    texts += [b"\x0b".join(t for t in texts if t) * 200, b"x" * 600_000, b"", b"a \n" * 200_000]
    found, seen = [], {}
    for h, cuts in word_hashes(texts):
        found += [h[a:b] for a, b in zip(cuts, cuts[1:])]
    for text, own in zip(texts, found, strict=True):
        words = text.lower().split()
        assert len(words) == len(own)
        for w, h in zip(words, own.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    r = random.Random(6)
    links = [(r.getrandbits(40), 0) for _ in range(300)]
    ids = [x[0] for x in links]
    links = [(r.choice(ids), r.choice(ids)) for _ in range(220)] + [(ids[0], ids[0])]
    out = {x["id"]: x["label"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        if a != b:
            parent[find(a)] = find(b)
    assert set(out) == set(parent)
    assert len({(out[x], find(x)) for x in out}) == len(set(out.values())) == len({find(x) for x in out})


def test_jaccard_of_nothing(nothing):
    assert jaccard.link_components(nothing).count() == 0
    assert jaccard.keep_one(nothing, ["doc_id", "text"]).count() == 0


# decontamination

BENCH = [
    (1, "w1 W2, w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (2, "e1 e2"), (None, "shared line"), (3, None), (4, "..."), (5, "ONE"), (5, "Two words"),
]


@pytest.mark.parametrize("block_words", [10**6, 5])
@pytest.mark.parametrize("width", [10, 3])
def test_decontamination(spark, docs, width, block_words):
    r = random.Random(8)
    some = brute.bench_words(ROWS[12][1])
    bench = [*BENCH, (6, " ".join(some[:14])), (7, " ".join(some[2:15]))]
    bench += [(10 + i, " ".join(f"w{r.randint(0, 59)}" for _ in range(r.randint(1, 3)))) for i in range(5)]
    df = spark.createDataFrame(bench, "item_id long, text string")
    out = decontaminate.contamination_report(decontaminate.find_benchmark(docs, df, width, block_words, keep=("sig",)).drop("sig"))
    sha = lambda names: hashlib.sha256(",".join(names).encode()).hexdigest()
    expected = [(d, n, h, len(i), sha(i), h > 0) for d, n, h, i in brute.contamination(ROWS, bench, width)]
    assert by_all(map(tuple, out.collect())) == by_all(expected)


def test_decontamination_of_nothing(spark, docs, nothing):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_benchmark(nothing, empty).count() == 0
    assert decontaminate.contamination_report(decontaminate.find_benchmark(docs, empty)).where("contaminated").count() == 0


# top k


def vectors(seed, n, dims=9):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(15)]  # ties
    rows += [(None, rows[0][1]), (n + 20, None), (n + 21, [None] * dims), (n + 22, [math.nan] * dims), (n + 23, [math.inf] * dims)]
    rows += [rows[5], rows[10], (n + 30, rows[1][1][:4]), (n + 31, [])]
    return rows


@pytest.mark.parametrize("nodes, block", [(4, 4096), (1, 4096), (3, 5)])
def test_top_k(spark, nodes, block):
    rows = vectors(1, 200)
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, uid string").repartition(4)
    out = topk.top_k(df, F.col("vec_id") % 10 == 0, k=10, nodes=nodes, query_block=block)
    assert by_all(map(tuple, out.collect())) == by_all(brute.top_k(rows, 10, 10))


def test_top_k_of_few(spark):
    rows = [(0, [1.0, 2.0]), (1, [-1.0, 0.0]), (2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.top_k(df, F.col("vec_id") % 2 == 0, k=10)
    assert by_all(map(tuple, out.collect())) == by_all(brute.top_k(rows, 10, 2))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


# language model


def test_lattice_sums_all_paths():
    weights = {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.15, "ba": 0.1, "▁a": 0.05, "▁ab": 0.02, "<0xC3>": 0.01, "<0xA9>": 0.02}
    lat = lattice.Lattice({p: math.log(w) for p, w in weights.items()})

    def total(word):
        if not word:
            return 1.0
        out = sum(w * total(word[len(p) :]) for p, w in weights.items() if word.startswith(p))
        return out + (weights["<0xC3>"] * weights["<0xA9>"] * total(word[1:]) if word[0] == "é" else 0.0)

    for word in ("▁ab", "▁abab", "▁bé", "▁abéab", "▁" + "ab" * 8):
        assert math.isclose(math.exp(lat.log_probability(word)), total(word), rel_tol=1e-9)
        uses = [0.0] * len(weights)
        assert math.isclose(lat.expected(word, 1.0, uses), math.log(total(word)), rel_tol=1e-9)
        assert math.isclose(sum(u * (len(p) if len(p) < 6 else 0.5) for u, p in zip(uses, weights)), len(word), rel_tol=1e-9)
    assert math.isfinite(lat.log_probability("▁" + "ab" * 20_000))


def lm_brute(rows):
    counts = Counter()
    words = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    for d, t in rows:
        if not held(d):
            counts.update(words(t))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        w = words(t)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        out.append((d, held(d), len(w), sum(counts[x] > 0 for x in w), total, round(base, 5)))
    return out, counts


@pytest.mark.parametrize("top", [10**6, 5, 0])
def test_lm_base(docs, top):
    out = lattice.score(docs, queries.PIECES, top_words=top)
    got = [(*r[:5], round(r[5], 5)) for r in out.collect()]
    assert by_all(got) == by_all(lm_brute(ROWS)[0])


def test_lm_scores_do_not_depend_on_what_is_broadcast(docs):
    one, two = ({r["doc_id"]: r["score"] for r in lattice.score(docs, queries.PIECES, top_words=t).where("doc_id is not null").collect()} for t in (10**6, 3))
    assert one.keys() == two.keys() and all(math.isclose(one[d], two[d], rel_tol=1e-9) and one[d] < 0 for d in one)


def test_lm_prefers_text_like_the_corpus(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["river", "stone", "walking", "under", "light"]) for _ in range(30))) for i in range(300)]
    odd = [(1000 + i, " ".join("".join(r.choice("qxzjkv") for _ in range(6)) for _ in range(30))) for i in range(20)]
    out = lattice.score(frame(spark, rows + odd), queries.PIECES).where("held_out").collect()
    like = [x["score"] / x["n_tokens"] for x in out if x["doc_id"] < 1000]
    unlike = [x["score"] / x["n_tokens"] for x in out if x["doc_id"] >= 1000]
    assert like and min(like) > -2
    assert not unlike or max(unlike) < -2


def test_lm_of_nothing(spark, nothing):
    assert lattice.score(nothing, queries.PIECES).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = lattice.score(frame(spark, [(held, "no training text")]), queries.PIECES).first()
    assert only["train_tokens"] == 0 and only["n_known"] == 0 and math.isfinite(only["score"]) and only["base_score"] == 0
