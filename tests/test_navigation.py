"""Trees, lookups and similar paths against small brute-force versions."""

import random

from pyspark.sql import functions as F

from repovigil.functions.skew import SALTS, salted_lookup
from repovigil.operators import lookup, tree
from repovigil.operators.order import ordered_positions


def drawn(paths, depth):
    """The tree as nested dicts, drawn depth first."""
    root = {}
    for path in paths:
        parts, node = path.split("/"), root
        for level, part in enumerate(parts[:depth], start=1):
            if level == len(parts):
                node[part] = None
            elif level == depth:
                node[part + "/..."] = None
            else:
                if not isinstance(node.get(part), dict):
                    node[part] = {}
                node = node[part]

    def order(node):
        number = [k for k in node if k.isdigit() and str(int(k)) == k and int(k) < 4294967295]
        return sorted(number, key=int) + [k for k in node if k not in number]

    def draw(node, indent):
        keys = order(node)
        for i, key in enumerate(keys):
            last = i == len(keys) - 1
            yield indent + ("└── " if last else "├── ") + key
            if node[key]:
                yield from draw(node[key], indent + ("    " if last else "│   "))

    return list(draw(root, ""))


def lines(df):
    return [r.line for r in df.orderBy("line_no").collect()]


def test_random_trees(files):
    rng = random.Random(7)
    for depth in (3, 10):
        paths = ["/".join(rng.choice(["a", "b", "10", "2", "c.ts", "4294967295", "01"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
        got = tree.render_tree(files([("r", p, "") for p in paths]), depth)
        assert lines(got) == drawn(paths, depth)
        assert [r.line_no for r in got.orderBy("line_no").collect()] == list(range(len(drawn(paths, depth))))


def test_later_write_replaces(files):
    for paths in (["a", "a/x", "b"], ["a/x", "a", "b"], ["a/x", "a", "a/y/z", "b", "a/y"]):
        assert lines(tree.render_tree(files([("r", p, "") for p in paths]))) == drawn(paths, 10)


def test_tree_text_of_any_size(files):
    rows = tree.render_tree(files([("small", "a", "")] + [("large", f"f{i:05}", "") for i in range(12_000)]))
    got = {r.repo_id: r for r in tree.tree_text(rows).collect()}
    assert got["small"].tree == "└── a\n"
    assert got["large"].tree == "".join(f"{'└── ' if i == 11_999 else '├── '}f{i:05}\n" for i in range(12_000))
    assert got["large"].tree_chars == len(got["large"].tree)


def test_positions_span_partitions(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", rng.random(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    got = {r.i: r.pos for r in ordered_positions(df, ["g"], [F.col("x"), F.col("i")]).collect()}
    for group in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in ranked] == list(range(len(ranked)))


def test_salted_lookup_is_a_plain_join(spark):
    rows = spark.createDataFrame([("hot" if i % 4 else f"k{i}", i) for i in range(400)] + [("none", -1)], "k string, i int")
    names = rows.select("k").distinct().filter("k <> 'none'").withColumn("name", F.upper("k"))
    for how in ("inner", "left"):
        got = sorted(map(str, salted_lookup(rows, names, "k", ["i"], how).collect()))
        assert got == sorted(map(str, rows.join(names, "k", how).collect()))
    slices = rows.filter("k = 'hot'").select(F.pmod(F.xxhash64("i"), F.lit(SALTS))).distinct().count()
    assert slices == SALTS


def ask(spark, wanted):
    return spark.createDataFrame(
        [("r", i, f, again) for i, (f, again) in enumerate(wanted)], "repo_id string, request_id bigint, file string, already_read boolean"
    )


def test_lookup_normalizes_and_empty_means_missing(spark, files):
    rows = files([("r", "./a.ts", "first"), ("r", "a.ts", "second"), ("r", "e.ts", ""), ("q", "z.ts", "other repository")])
    got = {r.file: (r.found, r.content) for r in lookup.lookup_files(ask(spark, [(f, False) for f in ("a.ts", "/a.ts", "e.ts", "z.ts", "//a.ts")]), rows).collect()}
    assert got["a.ts"] == got["/a.ts"] == (True, "first")
    assert got["e.ts"][0] is False and got["z.ts"] == (False, None) and got["//a.ts"][0] is False


def test_similar_files_match_brute_force(spark, files):
    rng = random.Random(3)
    names = ["src", "lib", "User.ts", "user", "s", "a.b", "Ärger", "x"]
    paths = ["/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(80)]
    wanted = ["/api/x.ts", "USER", "none", "ser.t/zzz", "är", "src/lib/", "b", ""]
    got = lookup.similar_files(ask(spark, [(w, False) for w in wanted]), files([("r", p, "") for p in paths])).orderBy("request_id", "ord").collect()
    for i, want in enumerate(wanted):
        parts = want.lower().split("/")
        expect = [p for p in paths if any(s in p.lower() for s in parts)][:5]
        assert [r.path for r in got if r.request_id == i] == expect, want


def test_messages(spark, files):
    rows = files([("r", "a.ts", "text"), ("r", "b.ts", "")])
    got = [r.message for r in lookup.file_messages(ask(spark, [("a.ts", False), ("a.ts", True), ("b.ts", False)]), rows).orderBy("request_id").collect()]
    assert got[0].startswith("**File: a.ts**\n```\ntext\n```\n\nContinue tracing")
    assert got[1].startswith("You've already read this file. Here it is again:\n\n**File: a.ts**\n```\ntext")
    assert got[2].startswith("File not found: b.ts\n\nAvailable files matching pattern:\n- b.ts\n\nPlease request")


def test_lookup_leaves_unmatched_texts_where_they_are(spark, files):
    """With broadcast joins off, the exchange that carries text lies behind the bucket filter."""
    rows = files([("r", f"f{i}.ts", f"text {i}") for i in range(200)])
    wanted = spark.createDataFrame([("r", 1, "f7.ts"), ("r", 2, "nope.ts")], "repo_id string, request_id int, file string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup.lookup_files(wanted, rows)
        assert {(r.request_id, r.found, r.content) for r in out.collect()} == {(1, True, "text 7"), (2, False, None)}
        plan = out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [_bucket" in plan


def test_intermediate_tables_can_be_removed(spark, tmp_path):
    import os

    from repovigil import session

    made = session.written(spark.range(3).toDF("id"), "gone")
    folder = made.inputFiles()[0].split("/part-")[0].removeprefix("file://")
    assert os.path.isdir(folder) and made.count() == 3
    kept, session._MADE[:] = session._MADE[:-1], session._MADE[-1:]  # only this one: others still in use
    assert session.remove_intermediate(spark) == 1 and not os.path.exists(folder)
    session._MADE[:] = kept


def test_similar_files_random(spark, files):
    """Segments shorter and longer than a piece, components of many pieces, empty ones, two repositories."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abÄ.") for _ in range(n))
    paths = ["/".join(word(rng.choice([0, 1, 2, 3, 5, 9, 40])) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    wanted = ["/".join(word(rng.choice([1, 2, 3, 4, 6])) for _ in range(rng.randint(1, 2))) for _ in range(120)] + ["", "/", paths[0].upper()]
    other = [("q", "/".join(word(3) for _ in range(2)), "") for _ in range(50)]
    got = lookup.similar_files(ask(spark, [(w, False) for w in wanted]), files([("r", p, "") for p in paths] + other))
    found = {}
    for r in got.orderBy("request_id", "ord").collect():
        found.setdefault(r.request_id, []).append(r.path)
    for i, want in enumerate(wanted):
        parts = want.lower().split("/")
        assert found.get(i, []) == [p for p in paths if any(s in p.lower() for s in parts)][:5], want


def exchanges(df):
    """Output columns of every exchange of the plan before it runs."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text, [line for line in text.split("\n") if "Exchange" in line]


def test_store_answers_as_lookup(spark, files):
    rng = random.Random(9)
    rows = [(rng.choice("rq"), rng.choice(["", "./", "/"]) + rng.choice("abcdef") + ".ts", rng.choice(["", f"text {i}"])) for i in range(60)]
    wanted = ask(spark, [(rng.choice(["", "./", "/", "//"]) + rng.choice("abcdefg") + ".ts", i % 3 == 0) for i in range(80)])
    frame = files(rows)
    store = lookup.TextStore.of(frame)
    assert store.texts.count() == len({(r, p.removeprefix(".").removeprefix("/")) for r, p, _ in rows})
    for direct, stored in ((lookup.lookup_files(wanted, frame), store.lookup(wanted)), (lookup.file_messages(wanted, frame), lookup.file_messages(wanted, store))):
        assert stored.columns == direct.columns
        assert sorted(map(str, stored.collect())) == sorted(map(str, direct.collect()))
    store.forget()
    assert not spark.catalog.tableExists(store.name)


def test_store_never_moves_texts(spark, files):
    """Without broadcasts: texts are scanned by bucket, only requests are exchanged and sorted."""
    store = lookup.TextStore.of(files([("r", f"f{i}.ts", "x" * 50) for i in range(200)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = spark.range(200_000).selectExpr("if(id >= 0, 'r', 'q') AS repo_id", "id AS request_id", "concat('f', id, '.ts') AS file")
        out = store.lookup(wanted)
        plan, moved = exchanges(out)
        assert plan.count("SortMergeJoin") == 1 and len(moved) == 1 and "Bucketed: true" in plan
        below = plan[plan.index("Exchange"):]
        assert "content" not in below.split("FileScan")[0]
        assert out.filter("found").count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        store.forget()


def test_unmatched_texts_stay_outside_the_exchange(spark, files):
    rows = files([("r", f"f{i}.ts", "x") for i in range(3000)])
    wanted = ask(spark, [(f"f{i}.ts", False) for i in range(0, 3000, 300)])
    assert lookup.lookup_files(wanted, rows).filter("found").count() == 10
    assert lookup.lookup_files(wanted, files([("q", "a", "x")])).filter("found").count() == 0


def test_path_parts_of_a_store_are_made_once(spark, files):
    """A lookup reads the store's path components, and asked pieces only leave the tasks that make them."""
    frame = files([("r", f"src/{name}{i % 7}/f{i}.ts", "x") for i, name in enumerate(["users", "orders", "a"] * 20)])
    wanted = ask(spark, [(f, False) for f in ("rders3/none", "f5", "SRC/x", "", "zzzz")])
    store = lookup.TextStore.of(frame)
    again = lookup.similar_files(wanted, store.paths, components=store.parts)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(again) == rows(lookup.similar_files(wanted, frame)) and again.count() > 0
    assert any("path-parts-" in f for f in again.inputFiles()) and any("postings-" in f for f in again.inputFiles())
    store.forget()
