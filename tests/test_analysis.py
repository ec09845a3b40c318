"""Rule-driven analysis and the end-to-end scan."""

import io
import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from repovigil.operators import analysis, clean, detect, report, rules
from repovigil.plans.corpus import view
from repovigil.plans.scan import scan
from repovigil.sources import archives, files as file_source, sinks
from conftest import SF


def test_routes_of_every_dialect(files):
    rows = files([
        ("r", "src/routes/u.ts", "router.get('/users/:id', h)\nrouter.post(`/users`, h)\napp.patch(\"/x\", h)"),
        ("r", "app.py", "@app.route('/a')\ndef a(): pass\n@bp.route(\"/b/<int:i>\", methods=['GET', 'POST'])"),
        ("r", "urls.py", "urlpatterns = [ path('health/', v), re_path('no', v)]"),
        ("r", "UserController.java", '@GetMapping("/u/{id}")\n@PostMapping(value = "/u")'),
        ("r", "users.controller.ts", "@Delete(':id')"),
        ("r", "web/app/api/items/route.ts", "export async function GET(r) {}\nexport function POST() {}"),
        ("r", "src/services/s.ts", "router.get('/hidden', h)"),
    ])
    got = sorted((r.path, r.method, r.route) for r in analysis.discover_endpoints(rows).collect())
    assert got == [
        ("UserController.java", "GET", "/u/{id}"), ("UserController.java", "POST", "/u"),
        ("app.py", "GET", "/a"), ("app.py", "GET", "/b/<int:i>"), ("app.py", "POST", "/b/<int:i>"),
        ("src/routes/u.ts", "GET", "/users/:id"), ("src/routes/u.ts", "PATCH", "/x"), ("src/routes/u.ts", "POST", "/users"),
        ("urls.py", "ANY", "health/"), ("urls.py", "ANY", "no"),
        ("users.controller.ts", "DELETE", ":id"),
        ("web/app/api/items/route.ts", "GET", "/api/items"), ("web/app/api/items/route.ts", "POST", "/api/items"),
    ]
    flows = {r.flow_name: r for r in analysis.group_crud_flows(analysis.discover_endpoints(rows)).collect()}
    assert flows["src/routes/u.ts#/users"].methods == ["GET", "POST"]
    assert flows["src/routes/u.ts#/users"].sensitivity_level == "high"
    assert "urls.py#/health#ANY health/" in flows


def test_imports_resolve_and_cycles_end(files):
    rows = files([
        ("r", "src/routes/a.ts", "import x from '../lib/b'\nimport e from 'express'"),
        ("r", "src/lib/b.ts", "const c = require('./c.js'); import('../lib')"),
        ("r", "src/lib/c.js", "import a from '../routes/a'"),
        ("r", "src/lib/index.ts", "import z from '../../../outside'"),
        ("r", "m.py", "from src.lib import c\nfrom pkg import thing"),
        ("q", "src/lib/b.ts", ""),
    ])
    edges = {(r.repo_id, r.ord, r.target) for r in analysis.import_edges(rows).collect()}
    assert edges == {("r", 0, 1), ("r", 1, 2), ("r", 1, 3), ("r", 2, 0), ("r", 4, 2), ("r", 4, 3)}
    start = rows.filter("ord = 0").select("repo_id", "ord")
    got = {(r.ord, r.depth) for r in analysis.trace_imports(analysis.import_edges(rows), start).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 2)}
    assert analysis.trace_imports(analysis.import_edges(rows), start, max_depth=2).count() == 2


def test_checklist_caps(spark, files):
    text = "\n".join(f"router.{m}('/{p}', h)" for p in ("auth/login", "users/:id", "status", "things/:id") for m in ("get", "post", "put", "delete"))
    flows = analysis.group_crud_flows(analysis.discover_endpoints(files([("r", "routes/x.ts", text)])))
    for row in analysis.build_checklists(flows).collect():
        total = len(row.required_controls) + len(row.recommended_controls)
        assert total <= rules.CONTROL_CAP[row.sensitivity_level]
        if row.sensitivity_level == "low":
            assert row.recommended_controls == []
        if row.sensitivity_level == "medium":
            assert all(c.importance in ("critical", "high") for c in row.recommended_controls)
        assert {c.category for c in row.required_controls + row.recommended_controls} <= set(rules.CATEGORIES)


def test_risky_lines_are_searched_once(files):
    """Patterns read the lines that hold a needle of their rule, and never the whole text."""
    rows = files([("r", "a.ts", "check the role\nverify = false // here\nplain\nx.innerHTML = y\nrole = req.x"), ("r", "b.ts", "role\n= req.y")])
    found = analysis.scan_vulnerabilities(rows)
    assert sorted((r.path, r.line_no, r.type) for r in found.collect()) == [
        ("a.ts", 2, "authentication_bypass"), ("a.ts", 4, "xss"), ("a.ts", 5, "authorization_flaw"),
    ]
    assert "RLIKE(content" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_vulnerability_lines_and_snippets(files):
    rows = files([("r", "a.ts", "first\nel.innerHTML = x\nlast\nnext"), ("r", "b.ts", "eval(req.body)"), ("r", "c", 'x\nAPI_KEY: "0123456789abcdefgh"')])
    got = {(r.path, r.line_no, r.type, r.snippet) for r in analysis.scan_vulnerabilities(rows).collect()}
    assert got == {
        ("a.ts", 2, "xss", "first\nel.innerHTML = x\nlast"), ("b.ts", 1, "command_injection", "eval(req.body)"),
        ("c", 2, "hardcoded_secret", 'x\nAPI_KEY: "0123456789abcdefgh"'),
    }


def test_scan_equals_the_single_operators(spark):
    """The one-pass scan and the separate operators agree; every control has one outcome."""
    app = view(spark, SF, "app_corpus").filter(~F.col("path").endswith(".java"))
    out = scan(app)
    flows = analysis.group_crud_flows(analysis.discover_endpoints(app))
    assert sorted(map(str, out["flows"].collect())) == sorted(map(str, flows.collect()))
    frameworks = detect.detect_frameworks(app)
    assert sorted(map(str, out["frameworks"].select("repo_id", "framework").collect())) == sorted(map(str, frameworks.select("repo_id", "framework").collect()))
    controls = out["controls"]
    assert controls.count() == analysis.checklist_controls(out["checklists"]).count() == controls.select("repo_id", "flow_name", "control_id").distinct().count()
    assert {r.outcome for r in controls.select("outcome").distinct().collect()} <= {"implemented", "missing", "auto_handled"}
    assert out["stats"].filter("included + ignored <> total").count() == 0
    assert out["scores"].filter("score < 0 OR score > 100").count() == 0


def test_score_limits_are_strict(spark):
    def score(rows):
        df = spark.createDataFrame([("r", "f", k, s) for k, s in rows], "run_id string, flow_name string, kind string, severity string")
        return report.with_grade(report.security_score(df, ["run_id"])).first()

    assert score([("implemented", "low")] * 4 + [("missing", "low")]).bonus == 5  # exactly 80 %
    assert score([("implemented", "low")] * 2 + [("auto_handled", "low")] * 3).bonus == 0  # exactly 40 %
    got = score([("vulnerability", "Critical")] * 8 + [("missing", "HIGH")])
    assert (got.deduction, got.bonus, got.score, got.grade) == (125, 0, 0, "F")
    assert score([("vulnerability", "high")]).grade == "A"


def test_archives_from_files(spark):
    folder = tempfile.mkdtemp(prefix="zips-")
    with zipfile.ZipFile(os.path.join(folder, "one.zip"), "w") as z:
        z.writestr("root/src/a.ts", "text")
        z.writestr("root/node_modules/b.ts", "skipped")
        z.writestr("root/big.txt", "x" * (3 * 1024 * 1024 + 1))
        z.writestr("root/", "")
        z.writestr("root/ü.md", "grüße")
    with open(os.path.join(folder, "bad.zip"), "wb") as f:
        f.write(b"broken")
    with open(os.path.join(folder, "note.txt"), "wb") as f:
        f.write(b"not an archive")
    got = [tuple(r) for r in archives.read_archives(spark, folder, strip=True).orderBy("ord").collect()]
    assert got == [("one", 0, "root/src/a.ts", "text"), ("one", 4, "root/ü.md", "grüße")]


def test_files_and_results_round_trip(spark, files):
    folder = tempfile.mkdtemp(prefix="tables-")
    rows = files([("r", "a", "x"), ("r", "b", None)])
    rows.write.json(folder + "/json")
    assert sorted(map(str, file_source.read_files(spark, folder + "/json", "json").collect())) == sorted(map(str, rows.collect()))
    sinks.write_results({"files": rows}, folder + "/out")
    assert file_source.read_files(spark, folder + "/out/files").count() == 2
    said = rows.withColumns({"agent": F.lit("checklists"), "run_id": F.col("repo_id")})
    assert sinks.write_transcripts(said, folder + "/t", "one") is True
    assert sinks.write_transcripts(said, folder + "/t", "one") is True  # replaces itself
    assert sinks.write_transcripts(said, folder + "/t", "two") is True
    assert spark.read.json(folder + "/t").count() == 4
    assert sinks.write_transcripts(rows, folder + "/t", "one") is False


def test_routes_of_more_dialects(files):
    rows = files([
        ("r", "src/users.controller.ts", "@Controller('users')\nclass A {\n @Get()\n all() {}\n @Post(':id/x')\n b() {} }"),
        ("r", "api/UserController.java", '@RequestMapping("/api")\nclass A {\n@GetMapping\nvoid a();\n@PostMapping("/u")\nvoid b();\n@RequestMapping(value = "/w", method = RequestMethod.PUT)\nvoid c(); }'),
        ("r", "api/views.py", '@bp.get("/a")\ndef a(): pass\nurlpatterns = [ re_path(r"^b/", v)]'),
        ("r", "src/routes/f.js", "fastify.route({ method: 'GET', url: '/f' })\napp.route('/w').get(h)\nusersRouter.delete('/u/:id', h)"),
    ])
    got = sorted((r.path, r.method, r.route) for r in analysis.discover_endpoints(rows).collect())
    assert got == [
        ("api/UserController.java", "GET", "/api"), ("api/UserController.java", "POST", "/api/u"), ("api/UserController.java", "PUT", "/api/w"),
        ("api/views.py", "ANY", "^b/"), ("api/views.py", "GET", "/a"),
        ("src/routes/f.js", "DELETE", "/u/:id"), ("src/routes/f.js", "GET", "/f"), ("src/routes/f.js", "GET", "/w"),
        ("src/users.controller.ts", "GET", "/users"), ("src/users.controller.ts", "POST", "/users/:id/x"),
    ]


def test_imports_of_every_form(files):
    rows = files([
        ("r", "src/a.ts", "import './side'\nimport x from '@/lib/x'\nconst y = require('../other/y')"),
        ("r", "src/side.ts", ""), ("r", "src/lib/x.ts", ""), ("r", "other/y/index.js", ""),
        ("r", "pkg/m.py", "import pkg.util, os\nfrom . import near\nfrom .deep import one as o, two\nfrom ..top import z\nfrom pkg.many import (p, q)"),
        ("r", "pkg/util.py", ""), ("r", "pkg/near.py", ""), ("r", "pkg/deep/__init__.py", ""), ("r", "pkg/deep/two.py", ""),
        ("r", "top.py", ""), ("r", "pkg/many/q.py", ""),
        ("r", "app/src/main/java/com/x/A.java", "package com.x;\nimport com.x.svc.B;\nimport static com.x.C.run;\nimport java.util.List;"),
        ("r", "app/src/main/java/com/x/svc/B.java", ""), ("r", "app/src/main/kotlin/com/x/C/run.kt", ""),
    ])
    paths = {r.ord: r.path for r in rows.collect()}
    got = {(paths[r.ord], paths[r.target]) for r in analysis.import_edges(rows).collect()}
    assert got == {
        ("src/a.ts", "src/side.ts"), ("src/a.ts", "src/lib/x.ts"), ("src/a.ts", "other/y/index.js"),
        ("pkg/m.py", "pkg/util.py"), ("pkg/m.py", "pkg/near.py"), ("pkg/m.py", "pkg/deep/__init__.py"),
        ("pkg/m.py", "pkg/deep/two.py"), ("pkg/m.py", "top.py"), ("pkg/m.py", "pkg/many/q.py"),
        ("app/src/main/java/com/x/A.java", "app/src/main/java/com/x/svc/B.java"),
        ("app/src/main/java/com/x/A.java", "app/src/main/kotlin/com/x/C/run.kt"),
    }


def test_archives_of_one_name_stay_apart(spark):
    folder = tempfile.mkdtemp(prefix="zips-")
    for owner in ("alice", "bob"):
        os.makedirs(os.path.join(folder, owner))
        with zipfile.ZipFile(os.path.join(folder, owner, "main.zip"), "w") as z:
            z.writestr("a.ts", owner)
            z.writestr("big.ts", "x" * 4_000_000)
    with open(os.path.join(folder, "notes.txt"), "w") as f:
        f.write("no archive")
    got = {(r.repo_id, r.path): r.content for r in archives.read_archives(spark, folder).collect()}
    assert got == {("alice/main", "a.ts"): "alice", ("bob/main", "a.ts"): "bob"}
    wide = archives.read_archives(spark, folder, max_units=5_000_000)
    assert wide.count() == 4
    _, refused = archives.scan_archives(spark, folder)
    assert [(r.repo_id, r.error) for r in refused.collect()] == [("notes.txt", archives.NOT_ZIP)]


def test_snippets_take_linear_time(spark):
    import time

    def seconds(lines):
        df = spark.createDataFrame([("r", 0, "a.ts", "eval(req.body)\n" * lines)], "repo_id string, ord bigint, path string, content string")
        start = time.perf_counter()
        assert analysis.scan_vulnerabilities(df).count() >= lines
        return time.perf_counter() - start

    seconds(100)
    assert seconds(20_000) < 4 * seconds(10_000) + 2


def test_a_repository_without_findings_scores_100(files):
    out = scan(files([("bare", "a.ts", "const x = 1"), ("dropped", "a.bin", "?")]))
    assert {(r.run_id, r.score, r.grade) for r in out["scores"].collect()} == {("bare", 100, "A"), ("dropped", 100, "A")}
    assert {(r.repo_id, r.total, r.included) for r in out["stats"].collect()} >= {("bare", 1, 1)}


def _routes(rows):
    return sorted((r.path, r.method, r.route) for r in analysis.discover_endpoints(rows).collect())


def test_routes_over_lines_and_in_any_order(files):
    rows = files([
        ("r", "src/routes/a.ts", "router.post(\n  '/users/:id',\n  h)\napp.all('/any', h); server.options(\"/o\", h)\n"
         "fastify.route({\n  url: '/u', schema: { method: 'X', url: '/no' },\n  method: ['GET', 'PUT'], handler: (r) => { r.get('/in') } })\n"
         "fastify.route({ handler: h, url: '/v', method: \"DELETE\" })\n"
         "router\n  .route('/w')\n  .all(auth({ a: [1] }))\n  .get(h)\n  .patch(h);\napp.route('/lone')\nother.get('/not/chained')"),
        ("r", "src/routes/dead.ts", "// app.get('/dead')\n/* router.put('/dead')\n*/\nconst s = \"use app.get('/quoted')\", t = `\napp.get('/t')`, u = 'http://x' // app.post('/dead')\napp.get('/live', /['\"]/)"),
        ("r", "api/V.java", '@GetMapping({"/a", "/b/{id:[0-9]+}"})\nvoid a();\n@PostMapping(produces = "x", path = "/c")\nvoid c();\n// @GetMapping("/dead")\n@RequestMapping(value = "/m", method = {RequestMethod.GET, RequestMethod.PUT})\nvoid m();\n@RequestMapping("/plain")\nvoid p();'),
        ("r", "api/v.py", '@app.post(\n    "/x",\n)\n@bp.route(\n  "/y", endpoint="(", methods=[\n "PUT",\n "DELETE"])\napp.add_url_rule("/z", view_func=f(1))\n# @app.get("/dead")\n"""\n@app.get("/doc")\n"""\n@app.head("/h")  # note'),
        ("r", "src/x.controller.ts", "@Controller({ path: 'things', version: '1' })\nclass X { @Get(['a', 'b']) f() {} @All() g() {} }"),
    ])
    assert _routes(rows) == [
        ("api/V.java", "ANY", "/plain"), ("api/V.java", "GET", "/a"), ("api/V.java", "GET", "/b/{id:[0-9]+}"), ("api/V.java", "GET", "/m"),
        ("api/V.java", "POST", "/c"), ("api/V.java", "PUT", "/m"),
        ("api/v.py", "DELETE", "/y"), ("api/v.py", "GET", "/z"), ("api/v.py", "HEAD", "/h"), ("api/v.py", "POST", "/x"), ("api/v.py", "PUT", "/y"),
        ("src/routes/a.ts", "ANY", "/any"), ("src/routes/a.ts", "ANY", "/w"), ("src/routes/a.ts", "DELETE", "/v"), ("src/routes/a.ts", "GET", "/u"),
        ("src/routes/a.ts", "GET", "/w"), ("src/routes/a.ts", "OPTIONS", "/o"), ("src/routes/a.ts", "PATCH", "/w"), ("src/routes/a.ts", "POST", "/users/:id"),
        ("src/routes/a.ts", "PUT", "/u"), ("src/routes/dead.ts", "GET", "/live"),
        ("src/x.controller.ts", "ANY", "/things"), ("src/x.controller.ts", "GET", "/things/a"), ("src/x.controller.ts", "GET", "/things/b"),
    ]


def test_long_and_broken_code_ends(files):
    rows = files([
        ("r", "src/routes/a.ts", "app.get('/a')\n" + "'" * 9999 + "\n" + '"' + '\\"' * 30_000 + "\n/*" + "*" * 50_000),
        ("r", "src/routes/b.ts", "(" * 20_000 + ".route({" + "{" * 5_000 + " url: '/no'"),
        ("r", "src/routes/c.ts", "app.use(" + "x, " * 20_000 + "\napp.get('/c')"),
        ("r", "api/d.py", "from a import (" + "b,\n" * 20_000 + ")\n" + '"""' * 3 + "\n@app.get('/d')\n"),
    ])
    assert _routes(rows) == [("api/d.py", "GET", "/d"), ("src/routes/a.ts", "GET", "/a"), ("src/routes/c.ts", "GET", "/c")]


def test_mounted_routers(files):
    rows = files([
        ("r", "server.js", "import users, { admin as boss } from './users/routes'\nimport * as v2 from '@/v2/routes'\napp.use('/u', users)\napp.use('/boss/', limit(3), boss)\napp.use('/v2', v2.router)\napp.use(cors())\napp.get('/', h)\napp.listen(1)"),
        ("r", "users/routes.js", "router.get('/:id', h)\nrouter.use('/more', require('./more/routes'))\nrouter.use('/up', require('../server'))"),
        ("r", "users/more/routes.js", "router.get('/x', h)\nrouter.use('/again', require('../routes'))"),
        ("r", "src/v2/routes.ts", "fastify.get('/y', h)"),
        ("r", "ring/a/routes.js", "router.use('/b', require('../b/routes'))\nrouter.get('/a', h)"),
        ("r", "ring/b/routes.js", "router.use('/a', require('../a/routes'))\nrouter.get('/b', h)"),
        ("q", "users/routes.js", "router.get('/other', h)"),
    ])
    assert _routes(rows) == [
        ("ring/a/routes.js", "GET", "/a"), ("ring/b/routes.js", "GET", "/b"),
        ("server.js", "GET", "/"),
        ("src/v2/routes.ts", "GET", "/v2/y"),
        ("users/more/routes.js", "GET", "/boss/more/x"), ("users/more/routes.js", "GET", "/u/more/x"),
        ("users/routes.js", "GET", "/boss/:id"), ("users/routes.js", "GET", "/other"), ("users/routes.js", "GET", "/u/:id"),
    ]


def test_imports_in_brackets(files):
    rows = files([
        ("r", "pkg/main.py", "from pkg.views import (  # both\n    users,\n    orders as o,  # renamed\n)\nfrom . import \\\n    tools\n# from pkg import dead\nimport pkg.last as l"),
        ("r", "pkg/views/users.py", ""), ("r", "pkg/views/orders.py", ""), ("r", "pkg/tools.py", ""), ("r", "pkg/dead.py", ""), ("r", "pkg/last.py", ""),
        ("r", "a.ts", "import {\n  b,\n  c\n} from\n  './b'\n// import x from './dead'\n/* require('./dead') */"), ("r", "b.ts", ""), ("r", "dead.ts", ""),
    ])
    assert {(r.ord, r.target) for r in analysis.import_edges(rows).collect()} == {(0, 1), (0, 2), (0, 3), (0, 5), (6, 7)}


def test_archives_in_turns_equal_one_reading(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="zips-")
    names = [f"g{i % 2}/p{i}.zip" for i in range(5)] + ["one.zip", "a [b]* {c}?.zip", "x%20y ü.zip", "g0/_hidden.zip", "_work/z.zip", ".tmp/z.zip", "_a=b/z.zip"]
    for name in names:
        os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
        with zipfile.ZipFile(os.path.join(folder, name), "w") as z:
            z.writestr("root/a.ts", name)
            z.writestr("root/b.md", "b")
    os.makedirs(os.path.join(folder, "g1", "empty"))
    with open(os.path.join(folder, "g1", "notes.txt"), "w") as f:
        f.write("no archive")
    monkeypatch.setattr(archives, "LISTED", 4)
    turns = list(archives.archive_turns(spark, folder, strip=True))
    assert [len(t.inputFiles()) for t in turns] == [4, 4, 2]  # what the driver knows at once
    got = sorted(tuple(r) for t in turns for r in t.collect())
    assert got == sorted(tuple(r) for r in archives.read_archives(spark, folder, strip=True).collect())
    assert {r[0] for r in got} == {"g0/p0", "g1/p1", "g0/p2", "g1/p3", "g0/p4", "one", "a [b]* {c}?", "x%20y ü", "_a=b/z"}
    kept, frameworks, _ = clean.clean_archives(archives.archive_turns(spark, folder, strip=True), strip=True)
    assert kept.count() == 18 and frameworks.count() == 9
    empty = tempfile.mkdtemp(prefix="zips-")
    assert [t.count() for t in archives.archive_turns(spark, empty)] == [0]
