"""The derived input tables of the registered queries.

Each view is one SQL text over the base tables. The text is plain enough for both engines, so a
check query inlines it as a CTE and reads the same rows as the Spark query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FILES_CORPUS = """
SELECT repo_id, doc_id AS ord,
  CASE k % 10 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/routes/' WHEN 2 THEN 'node_modules/pkg/' WHEN 3 THEN 'lib/out/'
       WHEN 4 THEN '' WHEN 5 THEN 'tests/' WHEN 6 THEN 'myvenv/lib/' WHEN 7 THEN 'app/Controllers/'
       WHEN 8 THEN 'src/output_' ELSE '.github/' END
  || 'f' || CAST(doc_id AS STRING) ||
  CASE k % 7 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.java' WHEN 3 THEN '.md' WHEN 4 THEN '.min.js'
       WHEN 5 THEN '.PNG' ELSE '' END AS path,
  CASE k % 7 WHEN 0 THEN CASE rn % 3 WHEN 0 THEN 'import express from ''express'''
                                     WHEN 1 THEN 'const f = require("fastify")'
                                     ELSE 'app.get("/api/x", h)' END || chr(10)
             WHEN 1 THEN CASE rn % 2 WHEN 0 THEN 'from flask import Flask' ELSE 'eval(user_input)' END || chr(10)
             WHEN 2 THEN '@RestController' || chr(10) ELSE '' END || text AS content
FROM (SELECT source AS repo_id, doc_id, text, CAST(substr(source,4) AS INT) AS rn,
             CAST(floor(doc_id/20) AS BIGINT) AS k FROM documents) d
UNION ALL
SELECT repo_id, CAST(-1 AS BIGINT) AS ord,
  CASE rn % 5 WHEN 0 THEN 'package.json' WHEN 1 THEN 'api/requirements.txt' WHEN 2 THEN 'pom.xml'
       WHEN 3 THEN 'next.config.mjs' ELSE 'README.md' END AS path,
  CASE rn % 5 WHEN 0 THEN CASE rn % 4 WHEN 0 THEN '{"dependencies":{"express":"^4"}}'
                                      WHEN 1 THEN '{"dependencies":{"@nestjs/core":"10"},"devDependencies":{"next":"15"}}'
                                      WHEN 2 THEN '{broken' ELSE '{"devDependencies":{"fastify":"4"}}' END
     WHEN 1 THEN 'Flask==3.0' WHEN 2 THEN '<a>spring-boot</a>' WHEN 3 THEN 'export default {}' ELSE 'none' END AS content
FROM (SELECT DISTINCT source AS repo_id, CAST(substr(source,4) AS INT) AS rn FROM documents) r
"""

# Web application sources: routes, imports that form chains, risky and protective lines.
APP_CORPUS = """
SELECT repo_id, doc_id AS ord,
  CASE doc_id % 6 WHEN 0 THEN 'src/routes/' WHEN 1 THEN 'src/controllers/' WHEN 2 THEN 'src/services/'
       WHEN 3 THEN 'src/handlers/' WHEN 4 THEN 'src/lib/' ELSE 'api/' END
  || 'm' || CAST(doc_id AS STRING) ||
  CASE WHEN doc_id % 6 = 5 THEN '.py' WHEN doc_id % 6 = 3 THEN '.java' ELSE '.ts' END AS path,
  CASE doc_id % 6
    WHEN 0 THEN 'import x from ''../services/m' || CAST(doc_id + 20 AS STRING) || '''' || chr(10)
      || '// app.get(''/dead'', h)' || chr(10) || 'const help = "try app.get(''/help'')"' || chr(10)
      || 'router.get(''/users/:id'', auth, h)' || chr(10) || 'router.post("/users", validate(body), h)' || chr(10)
      || CASE doc_id % 4 WHEN 0 THEN 'router.post("/auth/login", rateLimit({max: 5}), h)' || chr(10)
           || 'fastify.route({' || chr(10) || '  url: ''/bulk'',' || chr(10) || '  schema: { body: { url: ''/no'' } },' || chr(10)
           || '  method: [''GET'', "POST"],' || chr(10) || '  handler: h })'
                         ELSE 'app.delete(' || chr(10) || '  ''/orders/:oid'',' || chr(10) || '  h)' || chr(10)
           || 'router.route(''/tags'')' || chr(10) || '  .get(list({ a: 1 }), h)' || chr(10) || '  .put(h)' END || chr(10)
    WHEN 1 THEN 'const s = require("../handlers/m' || CAST(doc_id + 20 AS STRING) || '")' || chr(10)
      || '@Get(''health'')' || chr(10) || 'db.query("SELECT * FROM t WHERE id = " + req.params.id)' || chr(10)
      || 'app.use(helmet())' || chr(10)
    WHEN 2 THEN 'import y from ''../lib/m' || CAST(doc_id + 20 AS STRING) || '.ts''' || chr(10)
      || 'const h = await bcrypt.hash(password, 12)' || chr(10) || 'logger.info("audit")' || chr(10)
    WHEN 3 THEN CASE WHEN doc_id % 4 = 3 THEN '@RestController' || chr(10) ELSE '' END || '@GetMapping("/payments/{id}")' || chr(10) || '@PostMapping("/payments")' || chr(10)
      || '/* @DeleteMapping("/dead") */' || chr(10) || '@PutMapping(' || chr(10) || '  value = {"/payments/{id}", "/payments/bulk"})' || chr(10)
      || 'MessageDigest.getInstance("MD5")' || chr(10)
    WHEN 4 THEN 'import z from ''./m' || CAST(doc_id + 60 AS STRING) || '''' || chr(10)
      || 'el.innerHTML = req.body.html' || chr(10) || 'try { run() } catch (e) { res.status(500) }' || chr(10)
    ELSE '@app.route("/uploads/<int:uid>", methods=["GET", "PUT"])' || chr(10)
      || 'os.system("convert " + request.args.get("f"))' || chr(10) || 'data = pickle.loads(request.data)' || chr(10)
      || '# @app.get("/dead")' || chr(10) || '@app.post(' || chr(10) || '    "/uploads"' || chr(10) || ')' || chr(10)
      || 'from src.controllers import (' || chr(10) || '    m' || CAST(doc_id + 20 AS STRING) || ',  # next' || chr(10) || ')' || chr(10)
  END || text AS content
FROM (SELECT source AS repo_id, doc_id, text FROM documents) d
"""

# Services whose routers are mounted below paths, by way of several files, with a cycle.
MOUNT_CORPUS = """
SELECT repo_id, n * 10 + k AS ord, 'svc' || CAST(n AS STRING) || '/' || CASE k
    WHEN 0 THEN 'server.ts' WHEN 1 THEN 'api/index.ts' WHEN 2 THEN 'items/routes.ts' WHEN 3 THEN 'health/router.js'
    WHEN 4 THEN 'admin/routes.js' WHEN 5 THEN 'plugin/routes.js' WHEN 6 THEN 'main.py' WHEN 7 THEN 'views/users.py'
    WHEN 8 THEN 'views/orders.py' ELSE 'urls.py' END AS path,
  CASE k
    WHEN 0 THEN 'import {' || chr(10) || '  items,' || chr(10) || '  users as people,' || chr(10) || '} from ''./api''' || chr(10)
      || 'import health from "./health/router"' || chr(10) || 'const admin = require(''./admin/routes'')' || chr(10)
      || '// app.use(''/dead'', admin)' || chr(10) || 'app.use(helmet())' || chr(10) || 'app.use(''/api'', auth(), items)' || chr(10)
      || 'app.use(' || chr(10) || '  ''/health'',' || chr(10) || '  health' || chr(10) || ')' || chr(10) || 'app.use(admin)' || chr(10)
      || 'app.get(''/version'', h)' || chr(10) || 'app.listen(3000)' || chr(10)
    WHEN 1 THEN 'import { list } from ''../items/routes''' || chr(10) || 'router.use(''/v' || CAST(n % 3 AS STRING) || ''', list)' || chr(10)
      || 'router.use(''/again'', require(''../server''))' || chr(10) || 'router.get(''/'', h)' || chr(10)
    WHEN 2 THEN 'router.get(''/items/:id'', h)' || chr(10) || 'router.post(''/items'', h)' || chr(10)
    WHEN 3 THEN 'router.all(''/'', h)' || chr(10)
    WHEN 4 THEN 'fastify.register(require(''../plugin/routes''), { prefix: ''/p'' })' || chr(10) || 'router.options(''/o'', h)' || chr(10)
    WHEN 5 THEN 'fastify.route({ handler: h, url: ''/q'', method: ''HEAD'' })' || chr(10)
    WHEN 6 THEN 'from svc' || CAST(n AS STRING) || '.views import (' || chr(10) || '    users,  # people' || chr(10) || '    orders as o,' || chr(10) || ')' || chr(10)
      || 'app.include_router(' || chr(10) || '    users.router,' || chr(10) || '    prefix="/u"' || chr(10) || ')' || chr(10)
      || 'app.register_blueprint(o.bp, url_prefix=''/o'')' || chr(10)
      || 'urlpatterns = [path(''d/'', include(''svc' || CAST(n AS STRING) || '.urls'')), path(''x/'', v)]' || chr(10)
    WHEN 7 THEN 'router = APIRouter(prefix=''/p'')' || chr(10) || '@router.get(' || chr(10) || '    ''/{id}''' || chr(10) || ')' || chr(10)
    WHEN 8 THEN '@bp.route(''/x'', methods=[''POST''])' || chr(10)
    ELSE 'urlpatterns = [path(''y/'', v)]' || chr(10) END AS content
FROM (SELECT source AS repo_id, doc_id AS n FROM documents) d, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS parts(k)
"""

MODEL_RESPONSES = """
SELECT conv_id, turn, text || chr(10) || CASE (conv_id + turn) % 6
  WHEN 0 THEN 'Sure: {"status":"completed","result":{"flow_name":"F' || CAST(conv_id AS STRING) || '","required_controls":[],"recommended_controls":[],"references":[]}} bye'
  WHEN 1 THEN '{"status":"error","message":"no"}'
  WHEN 2 THEN 'no json here'
  WHEN 3 THEN '{"result":{}}'
  WHEN 4 THEN '{"status":"completed"}'
  ELSE '{"status":"odd","m":"a } b ' || chr(92) || chr(34) || ' {"} tail {"status":"error"}' END AS response
FROM conversations WHERE role = 'assistant'
"""

CONTROL_RESULTS = """
SELECT l_orderkey % 50 AS run_id, 'flow-' || CAST(l_orderkey AS STRING) AS flow_name, l_linenumber AS pos,
  'C-' || CAST(l_partkey AS STRING) AS control_id,
  CASE l_returnflag WHEN 'A' THEN 'implemented' WHEN 'N' THEN 'missing' ELSE 'auto_handled' END AS outcome,
  CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'medium' ELSE 'low' END AS severity
FROM lineitem
"""

VULNERABILITIES = """
SELECT l_orderkey % 50 AS run_id, 'flow-' || CAST(l_orderkey AS STRING) AS flow_name, l_linenumber AS pos,
  CASE l_suppkey % 3 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'xss' ELSE 'hardcoded_secret' END AS type,
  CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'high' ELSE 'critical' END AS severity
FROM lineitem WHERE l_linestatus = 'O'
"""

JOB_EVENTS = """
SELECT user_id AS job_id, event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'status' WHEN 'click' THEN 'progress' WHEN 'view' THEN 'log'
                  WHEN 'purchase' THEN 'result' ELSE 'error' END AS type,
  CASE WHEN event_type = 'signup' THEN CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running'
       WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'cancelled' END END AS status,
  CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) % 101 END AS progress
FROM events
"""

VIEWS = {
    "files_corpus": FILES_CORPUS,
    "app_corpus": APP_CORPUS,
    "mount_corpus": MOUNT_CORPUS,
    "model_responses": MODEL_RESPONSES,
    "control_results": CONTROL_RESULTS,
    "vulnerabilities": VULNERABILITIES,
    "job_events": JOB_EVENTS,
}
TABLES = ["customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a view's text over the base tables of ``sf_dir``."""
    for name in TABLES:
        if name in text:
            # a view name of our own: the caller may have views called like the tables
            table(spark, sf_dir, name).createOrReplaceTempView(f"repovigil_{name}")
            text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 repovigil_{name}", text)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return from_sql(spark, sf_dir, VIEWS[name])


def with_views(*names: str) -> str:
    """``WITH`` clause that inlines the named views into a check query."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
