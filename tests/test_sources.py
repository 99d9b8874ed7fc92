"""Sources, manifests, workspace files and enrichers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from arborlens.functions import enrich, enrichers
from arborlens.sources import manifests, workspace, workspace_files

COMPOSE = """
version: "3"
services:
  web:
    image: nginx:1.2
    depends_on: [api, cache]
    environment:
      API_URL: http://api:8080/v1
      PLAIN: text
    ports:
      - "80:8080"
  api:
    build: .
    environment:
      - DB=postgres://user:pw@db:5432/app
    volumes:
      - data:/var/lib
  cache:
    image: redis
"""
CLUSTER = """
apiVersion: apps/v1
kind: Deployment
metadata:
  name: shop
spec:
  template:
    spec:
      containers:
        - name: shop
          image: registry/shop:2
          env:
            - name: QUEUE
              value: amqp://mq.prod:5672
---
kind: Service
metadata: {name: shop-svc}
spec:
  selector:
    app: shop
  ports:
    - port: 80
      protocol: TCP
---
kind: Ingress
metadata:
  name: edge
spec:
  rules:
    - host: x.org
      http:
        paths:
          - path: /shop
            backend:
              service:
                name: shop-svc
"""


def facts(parser, text):
    return [(f["type"], f.get("name"), f.get("source"), f.get("target")) for f in parser(text)]


def test_compose():
    got = facts(manifests.compose, COMPOSE)
    assert ("runtime.component", "cache", None, None) in got and ("runtime.connection", "web->api", "web", "api") in got
    assert ("runtime.endpoint_ref", "API_URL", "web", "api") in got and ("runtime.endpoint_ref", "DB", "api", "db") in got
    assert ("runtime.endpoint", "8080/tcp", None, "web") in got and ("runtime.volume", "data", "api", "data") in got
    assert [f["kind"] for f in manifests.compose(COMPOSE) if f["type"] == "runtime.component"] == ["service", "service", "datastore"]


def test_cluster():
    got = facts(manifests.cluster, CLUSTER)
    assert got == [("runtime.component", "shop", None, None), ("runtime.endpoint_ref", "QUEUE", "shop", "mq.prod"), ("runtime.endpoint", "80/tcp", "shop-svc", "shop"), ("runtime.connection", "x.org/shop", "edge", "shop-svc")]


def test_contracts_and_infrastructure():
    proto = "syntax = \"proto3\";\nservice Cart {\n  rpc Add (Item) returns (stream Reply);\n}\nmessage Item {}\n"
    assert facts(manifests.contracts, proto) == [("grpc.contract", "Cart", None, None), ("grpc.method", "Cart.Add", "Item", "Reply")]
    tf = 'resource "aws_sqs_queue" "jobs" {\n}\nresource "aws_lambda_function" "work" {\n  arn = aws_sqs_queue.jobs.arn\n}\n'
    assert facts(manifests.infrastructure, tf) == [("runtime.component", "jobs", None, None), ("runtime.component", "work", None, None), ("runtime.connection", "aws_lambda_function.work->aws_sqs_queue.jobs", "work", "jobs")]
    api = json.dumps({"openapi": "3.0", "paths": {"/a": {"get": {}, "post": {}, "parameters": []}}})
    assert [f["name"] for f in manifests.api_description(api)] == ["GET /a", "POST /a"]


@pytest.mark.parametrize("path,text,want", [
    ("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.0\n)\n", ["github.com/a/b"]),
    ("x/package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}', ["react", "vite"]),
    ("requirements-dev.txt", "Flask==1.0  # web\n# none\nrequests>=2\n", ["flask", "requests"]),
    ("pyproject.toml", '[project]\nname = "x"\ndependencies = ["numpy>=1", "Pandas"]\n[tool.poetry.dependencies]\npython = "3"\nhttpx = "1"\n', ["httpx", "numpy", "pandas"]),
    ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1"\n[dev-dependencies]\nrand = { version = "1" }\n', ["rand", "serde"]),
    ("build.gradle", "implementation 'org.a:b:1'\ntestImplementation(\"c.d:e:2\")\n", ["c.d:e", "org.a:b"]),
    ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId></dependency>", ["g:a"]),
    ("conanfile.txt", "[requires]\nzlib/1.2.11\n", ["zlib"])])
def test_dependency_lists(path, text, want):
    assert manifests.dependencies(path, text) == want


def test_manifest_facts(spark):
    files = spark.createDataFrame([("docker-compose.yml", COMPOSE), ("k8s/app.yaml", CLUSTER), ("bad/docker-compose.yml", "a: b: c"), ("x.py", "import os"), ("none.tf", None)], "path string, content string")
    got = {(r["path"], r["type"]) for r in manifests.manifest_facts(files).collect()}
    assert ("docker-compose.yml", "runtime.component") in got and ("k8s/app.yaml", "runtime.connection") in got and not any(p in ("x.py", "none.tf") for p, _ in got)


def test_yaml_subset():
    text = "a:\n  - 1\n  - b: 'x y'\n    c: [1, \"t\", {k: v}]\n  -\n    - z\nd: |\n  one\n  two\ne: null\nf: {g: true}\n# end\n"
    assert manifests.documents(text) == [{"a": [1, {"b": "x y", "c": [1, "t", {"k": "v"}]}, ["z"]], "d": "one\ntwo", "e": None, "f": {"g": True}}]


def test_workspace_round_trip():
    elements = "web:\n  name: Web App\n  kind: service\n  tags:\n    - a\n  has_view: true\n  placements:\n    - parent: root\n      position_x: 10\n_meta:\n  x: 1\n"
    connectors = "c1:\n  view: root\n  source: web\n  target: db\n  label: reads\n"
    found, places, edges = workspace_files.load_workspace(elements, connectors)
    assert [(e["ref"], e["name"], e["tags"], e["has_view"]) for e in found] == [("web", "Web App", ["a"], True)] and places[0]["x"] == 10.0
    assert [(c["source"], c["target"], c["direction"]) for c in edges] == [("web", "db", "forward")]
    again = workspace_files.load_workspace(workspace_files.dump(found), workspace_files.dump(edges))
    assert again[0] == found and again[2] == edges
    assert workspace_files.workspace_hash(places) == workspace_files.workspace_hash([{**places[0], "x": 99.0}])


def test_merged_export_keeps_refs():
    own = [{"ref": "mine", "name": "Mine"}, {"ref": "old", "name": "Old"}]
    out = workspace_files.merged_export(own, [{"id": 5, "name": "Five"}, {"id": 6, "name": "Mine"}], {4: "old", 5: "five-kept"})
    assert [r["ref"] for r in out] == ["five-kept", "mine", "mine-2"]


def test_architecture_language():
    text = """workspace "W" { model {
      user = person "User"
      shop = softwareSystem "Shop" "Sells" { web = container "Web" "UI" "React" { -> db "reads" }
        db = container "DB" "" "Postgres" "store, sql" }
      user -> shop.web "uses" "HTTPS"
      user -> nobody "x" // unknown
    } views { systemContext shop { include * } } }"""
    elements, links, warnings = workspace_files.architecture(text)
    assert [(e["ref"], e["kind"], e["parent"], e["technology"]) for e in elements] == [("user", "person", None, None), ("shop", "system", None, None), ("web", "container", "shop", "React"), ("db", "container", "shop", "Postgres")]
    assert [(x["source"], x["target"], x["label"]) for x in links] == [("web", "db", "reads"), ("user", "web", "uses")] and len(warnings) == 1
    assert elements[3]["tags"] == ["store", "sql"]


def test_working_tree():
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n d\ndiff --git a/n b/n\nnew file mode 1\n@@ -0,0 +1,1 @@\n+z\n"
    assert workspace_files.hunks(diff) == [{"file": "x.py", "change_type": "updated", "added": [2], "removed": [2]}, {"file": "n", "change_type": "added", "added": [1], "removed": []}]
    assert workspace_files.tree_status("M  a\n D b\n?? c\nMM d\n") == [("a", "git:staged"), ("b", "watch:deleted"), ("c", "git:untracked"), ("d", "git:staged"), ("d", "git:unstaged")]
    assert workspace_files.blob_hash(b"hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_thumbnails_and_bundle(spark):
    boxes = spark.createDataFrame([(1, 5, 0, 0), (1, 6, 260, 0)], "view_id long, element_id long, x long, y long")
    edges = spark.createDataFrame([(1, 5, 6)], "view_id long, source_element_id long, target_element_id long")
    svg = workspace_files.thumbnails(boxes, edges).first()["svg"]
    assert 'viewBox="0 0 460 100"' in svg and svg.count("<rect") == 2 and '<line x1="100" y1="50" x2="360" y2="50"/>' in svg
    elements = spark.createDataFrame([(5, "a"), (6, "b")], "id long, name string")
    tree = spark.createDataFrame([(1, 0, "root"), (2, 1, "root/x")], "view_id long, depth int, path string")
    nav = spark.createDataFrame([(1, 2)], "from_view_id long, to_view_id long")
    out = {r["view_id"]: r for r in workspace_files.bundle(elements, boxes, edges, tree, nav).collect()}
    assert [x["name"] for x in out[1]["elements"]] == ["a", "b"] and out[1]["leads_to"] == [2] and out[2]["elements"] == [] and out[1]["connectors"] == 1


def test_languages_and_generated(spark):
    df = spark.createDataFrame([("a/go.mod",), ("x.ts",), ("y.proto",), ("z.bin",)], "p string")
    assert [tuple(r[0]) for r in df.select(enrichers.language_of(F.col("p"))).collect()] == [("go-mod", False), ("typescript", True), ("proto", False), (None, False)]
    assert spark.range(1).select(enrichers.generated(F.lit("// Code generated by x. DO NOT EDIT.\n"))).first()[0]


def test_scan_strategies(spark):
    files = spark.createDataFrame([(p,) for p in ("a.py", "Dockerfile", "b/main.go", "README.md")], "path string")
    assert {r[0] for r in workspace.planned(files, "limited", 2).collect()} == {"Dockerfile", "README.md"}
    assert workspace.planned(files, "auto", 1, 2).count() == 1 and workspace.planned(files, "full", 1, 2).count() == 4
    with pytest.raises(ValueError):
        workspace.planned(files, "abort", 1, 2)
    known = spark.createDataFrame([("a.py", "h", "ok", "v1")], "path string, hash string, status string, enriched string")
    now = spark.createDataFrame([("a.py", "h")], "path string, hash string")
    assert workspace.changed(now, known).isEmpty() and workspace.changed(now, known, "v2").count() == 1


def test_symbols_with_braces(spark):
    go = "package m\n\nfunc (s *S) Run(x int) {\n\tif ok(x) {\n\t\tstart(x) // stop()\n\t}\n}\n\ntype S struct {\n\ta int\n}\n"
    ts = "export class A {\n  go() { return 1 }\n}\nconst f = (x) => {\n  return g(x)\n}\n"
    files = spark.createDataFrame([("m.go", "go", go), ("a.ts", "typescript", ts)], "path string, language string, content string")
    got = {(r["name"], r["kind"], r["line"], r["end_line"], tuple(r["calls"])) for r in workspace.brace_symbols(files).collect()}
    assert ("Run", "function", 3, 7, ("ok", "start")) in got and ("S", "type", 9, 11, ()) in got
    assert any(n == "f" and (a, b) == (4, 6) and c == ("g",) for n, _, a, b, c in got)


def test_python_references(spark):
    files = spark.createDataFrame([("m.py", "python", "import os.path\nfrom a import b\nx = b(os.getcwd())\n")], "path string, language string, content string")
    got = [(r["name"], r["kind"], r["line"]) for r in workspace.python_references(files).orderBy("line", "name").collect()]
    assert got == [("os.path", "import", 1), ("a", "import", 2), ("b", "call", 3), ("getcwd", "call", 3)]


CASES = [
    ("a.py", "python", "from flask import Flask\n@app.route('/x')\ndef f(): pass", "python.flask", "http.route", "ANY /x"),
    ("a.py", "python", "from fastapi import FastAPI\n@app.get('/y')\ndef f(): pass", "python.fastapi", "http.route", "GET /y"),
    ("u.py", "python", "from django.urls import path\npath('p/', v)", "python.django", "http.route", "ANY p/"),
    ("m.go", "go", 'import (\n\t"github.com/gin-gonic/gin"\n)\nr.GET("/z", h)', "go.gin", "http.route", "GET /z"),
    ("m.go", "go", 'import (\n\t"net/http"\n)\nhttp.HandleFunc("/h", h)', "go.nethttp", "http.route", "ANY /h"),
    ("m.go", "go", 'import (\n\t"github.com/gorilla/mux"\n)\nr.HandleFunc("/g", h).Methods("POST")', "go.gorilla_mux", "http.route", "POST /g"),
    ("a.ts", "typescript", "import express from 'express'\napp.post('/e', h)", "ts.express", "http.route", "POST /e"),
    ("C.java", "java", 'import org.springframework.web.bind.annotation.GetMapping;\n@GetMapping("/s")', "java.spring_web", "http.route", "GET /s"),
    ("m.rs", "rust", 'use axum::Router;\nRouter::new().route("/r", get(h))', "rust.axum", "http.route", "GET /r"),
    ("m.cpp", "cpp", '#include "crow.h"\nCROW_ROUTE(app, "/c")', "cpp.crow", "http.route", "ANY /c"),
    ("app/shop/[id]/page.tsx", "typescript", "import x from 'next'", "ts.nextjs", "frontend.route", "/shop/:id"),
    ("r.tsx", "typescript", "import { Route } from 'react-router-dom'\n<Route path=\"/u\" />", "ts.react_router", "frontend.route", "/u"),
    ("p.ts", "typescript", "import { PrismaClient } from '@prisma/client'\nprisma.user.findMany()", "ts.prisma", "orm.query", "user.findMany"),
    ("s.py", "python", "import grpc\nadd_CartServicer_to_server(x, s)", "python.grpc", "grpc.server", "Cart"),
    ("d.py", "python", "u = 'postgresql://h/db'", "datastore.glue", "datastore.dependency", "postgresql"),
    ("l.py", "python", "from locust import HttpUser\nself.client.get('/l')", "python.locust", "http.client", "GET /l"),
]


def test_enrichers(spark):
    files = spark.createDataFrame([(f"{i}/{c[0]}", c[1], c[2]) for i, c in enumerate(CASES)], "path string, language string, content string")
    got = {(r["path"], r["enricher"], r["type"], r["name"]) for r in enrichers.facts_of(files).collect()}
    for i, (path, _, _, id_, type_, name) in enumerate(CASES):
        assert (f"{i}/{path}", id_, type_, name) in got


def test_enrichers_need_signals(spark):
    files = spark.createDataFrame([("a.py", "python", "@app.route('/x')")], "path string, language string, content string")
    assert enrichers.facts_of(files, only=["python.flask"]).isEmpty()
    asked = spark.createDataFrame([("a.py", "flask")], "path string, dependency string")
    assert enrichers.facts_of(files, asked, ["python.flask"]).count() == 1


def test_specified_facts(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"id": "x.redis", "type": "cache.key", "tokens": ["redis.get", "redis.set"], "languages": ["python"], "triggers": ["redis"], "path_tokens": ["svc"], "tags": ["cache"]}) + "\n")
    specs = enrichers.load_specs(spark, f"file://{tmp_path}/s.jsonl")
    rows = [("svc/a.py", "python", "redis.set(1); redis.get(2)", ["redis"]), ("svc/b.py", "python", "redis.get(1)", ["other"]), ("svc/c.go", "go", "redis.get(1)", ["redis"]), ("d.py", "python", "redis.get(1)", ["redis"]), ("svc/e.py", "python", "# redis.get(1)", ["redis/x"])]
    got = enrichers.specified_facts(spark.createDataFrame(rows, "path string, language string, content string, signals array<string>"), specs).collect()
    assert [(r["path"], r["name"], r["tags"]) for r in got] == [("svc/a.py", "redis.get", ["cache"])]


def test_route_method_group(spark):
    files = spark.createDataFrame([("a", "get('/x') post('/y')")], "path string, content string")
    assert sorted(r["name"] for r in enrich.route_facts(files, r"(get|post)\('([^']+)'\)", 1, 2).collect()) == ["GET /x", "POST /y"]


def test_vectors_are_saved_by_model(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    for model, n in (("a", 2), ("b", 1), ("a", 3)):
        workspace_files.save_vectors(spark.range(n).selectExpr("id as owner", "'h' as input_hash", "array(0.5) as vector"), path, model)
    assert {(r["model"], r["count"]) for r in spark.read.parquet(path).groupBy("model").count().collect()} == {("a", 3), ("b", 1)}


def test_read_surface(spark):
    import threading
    import urllib.error
    import urllib.request

    from arborlens.sources import serve

    queries = {"numbers": lambda s, d: s.range(10).withColumnRenamed("id", "n")}
    page = serve.read(spark, "", queries, "numbers", 2, 3)
    assert [r["n"] for r in page["rows"]] == [2, 3, 4] and page["total"] == 10 and page["columns"] == ["n"]

    def hook(name):
        if name == "secret":
            raise PermissionError("no")

    http = serve.server(spark, "", {**queries, "secret": queries["numbers"]}, hooks=(hook,))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"
    try:
        assert json.load(urllib.request.urlopen(f"{base}/"))["queries"] == ["numbers", "secret"]
        assert json.load(urllib.request.urlopen(f"{base}/numbers?limit=2&offset=8"))["rows"] == [{"n": 8}, {"n": 9}]
        for path, status in (("nothing", 404), ("secret", 403)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(f"{base}/{path}")
            assert e.value.code == status
    finally:
        http.shutdown()


def test_providers(spark):
    from arborlens.functions import embedding

    rows = spark.createDataFrame([(1, "def get(): return 1"), (2, "def get(): return 2"), (3, "class Other: pass")], "owner long, text string")
    v = {r["owner"]: r["vector"] for r in embedding.embedded(rows, "lexical", 64).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    assert abs(dot(1, 1) - 1) < 1e-9 and dot(1, 2) > dot(1, 3)
    assert embedding.embedded(rows, "none").count() == 0 and len(embedding.embedded(rows, "deterministic", 8).first()["vector"]) == 8
    with pytest.raises(ValueError):
        embedding.embedded(rows, "x")


def test_change_source(spark, tmp_path):
    from arborlens.streaming import changes

    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "m.py").write_text("x")
    (tmp_path / "in" / "n.bin").write_text("x")
    out = changes.source(spark, f"file://{tmp_path}/in").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    out.awaitTermination()
    assert [r["path"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["a/m.py"]


def test_route_options_in_any_order(spark):
    text = "app.get('/a', h)\napp.route({ url: '/b', schema, method: ['GET', 'HEAD'], handler: h })\napp.route({\n  method: \"POST\",\n  url: `/c`\n})\napp.route({ handler: h })"
    files = spark.createDataFrame([("x.ts", "typescript", "import f from 'fastify'\n" + text)], "path string, language string, content string")
    got = {(r["name"], r["line"]) for r in enrichers.facts_of(files, None, ["ts.fastify"]).collect()}
    assert got == {("GET /a", 2), ("GET /b", 3), ("HEAD /b", 3), ("POST /c", 4)}
