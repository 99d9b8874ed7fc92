"""Enrichers as table functions: a registry of (file -> facts), activation by signals, route families and special ones.

An enricher has an id, the languages it reads, the imports or dependencies that activate it (none: always) and a
function from a path and a text to facts. facts_of runs all that are active over files in Arrow batches, then
normalises and validates: trimmed names, confidence within 0..1, one row for each (file, enricher, type, name, line). A
catalogue of token specifications comes as a table or a JSON file (load_specs), one row each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.functions.enrich import LANGUAGES

FACT_SCHEMA = "path string, enricher string, type string, name string, line long, confidence double, hint double"
#: Languages of files known by their whole names, and of endings that carry no symbols.
MANIFESTS = {"go.mod": "go-mod", "package.json": "npm", "cargo.toml": "cargo", "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "pyproject.toml": "python-project", "requirements.txt": "requirements", "requirements.in": "requirements", "dockerfile": "dockerfile", "conanfile.txt": "conan"}
DATA_ENDINGS = {".yaml": "yaml", ".yml": "yaml", ".proto": "proto", ".tf": "terraform", ".csproj": "csharp-project", ".cs": "csharp", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".hpp": "cpp", ".cxx": "cpp"}
PARSEABLE = {"c", "cpp", "go", "java", "javascript", "python", "rust", "typescript"}


def language_of(path: Column) -> Column:
    """struct(language, parseable): by a manifest's name, else by ending; null language for other files."""
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    found = F.coalesce(F.try_element_at(table(MANIFESTS), base), F.try_element_at(table({**LANGUAGES, **DATA_ENDINGS}), F.regexp_extract(base, r"(\.[a-z0-9]+)$", 1)))
    return F.struct(found.alias("language"), F.coalesce(found.isin(*PARSEABLE), F.lit(False)).alias("parseable"))


def generated(head: Column) -> Column:
    """A generator's mark among the first 20 lines."""
    return F.array_join(F.slice(F.split(F.substring(head, 1, 8192), "\n"), 1, 20), "\n").rlike(r"(?m)^(//|#|/\*).*[Cc]ode generated .*DO NOT EDIT")


@dataclass(frozen=True)
class Enricher:
    id: str
    languages: frozenset[str]
    triggers: tuple[str, ...]
    read: Callable[[str, str], Iterator[dict]] = field(compare=False)


REGISTRY: dict[str, Enricher] = {}


def register(id_: str, languages: str, *triggers: str):
    """Add an enricher under an id of its own."""
    def add(f):
        if id_ in REGISTRY:
            raise ValueError(f"enricher {id_} is there already")
        REGISTRY[id_] = Enricher(id_, frozenset(languages.split()), triggers, f)
        return f

    return add


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def routes(id_: str, languages: str, triggers: tuple[str, ...], *patterns: tuple[str, int | str, int]):
    """Register a family of routes: patterns (expression, group of the method or a fixed method, group of the path)."""
    compiled = [(re.compile(p), method, group) for p, method, group in patterns]

    @register(id_, languages, *triggers)
    def read(path: str, text: str) -> Iterator[dict]:
        for expression, method, group in compiled:
            for m in expression.finditer(text):
                verb = m[method].upper() if isinstance(method, int) else method
                yield {"type": "http.route", "name": f"{verb} {m[group] or '/'}", "line": _line(text, m.start()), "confidence": 0.9, "hint": 1.0}

    return read


QUOTED = r"""["'`]([^"'`\n]+)["'`]"""
VERBS = "get|post|put|delete|patch|head|options"
# Families by language; what they look for follows from each framework's public interface.
for _name in ("express", "hono"):
    routes(f"ts.{_name}", "typescript javascript", (_name,), (rf"\b(?:app|router|server|api)\.({VERBS})\(\s*{QUOTED}", 1, 2))
# Shorthand calls; and route(options), whose keys come in any order, with one method or a list of them.
_OPTIONS = re.compile(r"\.route\(\s*\{(.*?)\}\s*\)", re.S)
_OPTION_METHODS = re.compile(r"""\bmethod\s*:\s*(\[[^\]]*\]|["'`]\w+["'`])""")
_OPTION_URL = re.compile(rf"\b(?:url|path)\s*:\s*{QUOTED}")


@register("ts.fastify", "typescript javascript", "fastify")
def fastify_routes(path: str, text: str) -> Iterator[dict]:
    found = [(m.start(), m[1], m[2]) for m in re.finditer(rf"\b\w+\.({VERBS})\(\s*{QUOTED}", text)]
    for options in _OPTIONS.finditer(text):
        methods, url = _OPTION_METHODS.search(options[1]), _OPTION_URL.search(options[1])
        if methods and url:
            found += [(options.start(), verb, url[1]) for verb in re.findall(r"\w+", methods[1])]
    for at, verb, url in sorted(found):
        yield {"type": "http.route", "name": f"{verb.upper()} {url}", "line": _line(text, at), "confidence": 0.9, "hint": 1.0}


routes("ts.nestjs", "typescript javascript", ("@nestjs/common",), (r"@(Get|Post|Put|Delete|Patch|Head|Options)\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?\s*\)", 1, 2), (rf"@Controller\(\s*{QUOTED}", "ANY", 1))
routes("go.nethttp", "go", ("net/http",), (r"""\bHandle(?:Func)?\(\s*"(?:([A-Z]+) )?(/[^"]*)\"""", "ANY", 2))
for _name, _module in (("gin", "github.com/gin-gonic/gin"), ("echo", "github.com/labstack/echo"), ("gorilla_mux", "github.com/gorilla/mux")):
    routes(f"go.{_name}", "go", (_module,), *([(r"""\bHandleFunc\(\s*"([^"]+)"[^\n]*?\.Methods\(\s*"([A-Z]+)\"""", 2, 1)] if _name == "gorilla_mux" else [(r"""\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\(\s*"([^"]+)\"""", 1, 2)]))
for _name, _module in (("chi", "github.com/go-chi/chi"), ("fiber", "github.com/gofiber/fiber")):
    routes(f"go.{_name}", "go", (_module,), (r"""\.(Get|Post|Put|Delete|Patch|Head|Options)\(\s*"([^"]+)\"""", 1, 2))
routes("python.flask", "python", ("flask",), (rf"@\w+\.route\(\s*{QUOTED}(?:[^)]*methods\s*=\s*\[\s*[\"'](\w+)[\"'])?", "ANY", 1))
routes("python.fastapi", "python", ("fastapi",), (rf"@\w+\.({VERBS})\(\s*{QUOTED}", 1, 2))
routes("python.django", "python", ("django",), (rf"\b(?:path|re_path|url)\(\s*r?{QUOTED}", "ANY", 1))
routes("python.starlette", "python", ("starlette",), (rf"\bRoute\(\s*{QUOTED}", "ANY", 1))
routes("java.spring_web", "java", ("org.springframework",), (r"""@(Get|Post|Put|Delete|Patch)Mapping\(\s*(?:(?:value|path)\s*=\s*)?"([^"]*)\"""", 1, 2), (r"""@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?"([^"]*)\"""", "ANY", 1))
for _name, _module in (("jax_rs", "javax.ws.rs"), ("quarkus", "jakarta.ws.rs")):
    routes(f"java.{_name}", "java", (_module,), (r"""@Path\(\s*"([^"]+)\"""", "ANY", 1))
routes("java.micronaut", "java", ("io.micronaut",), (r"""@(Get|Post|Put|Delete|Patch)\(\s*"([^"]*)\"""", 1, 2))
routes("rust.axum", "rust", ("axum",), (rf"\.route\(\s*\"([^\"]+)\"\s*,\s*({VERBS})\(", 2, 1))
for _name, _module in (("actix_web", "actix_web"), ("rocket", "rocket")):
    routes(f"rust.{_name}", "rust", (_module,), (rf"#\[({VERBS})\(\s*\"([^\"]+)\"", 1, 2))
routes("rust.warp", "rust", ("warp",), (r"""warp::path!?\(\s*"([^"]+)\"""", "ANY", 1))
routes("cpp.crow", "cpp", ("crow.h", "crow"), (r"""CROW_ROUTE\(\s*\w+\s*,\s*"([^"]+)\"""", "ANY", 1))
routes("cpp.drogon", "cpp", ("drogon",), (r"""(?:ADD_METHOD_TO|METHOD_ADD)\([^,]+,\s*"([^"]+)"\s*,\s*(Get|Post|Put|Delete|Patch)""", 2, 1))
routes("cpp.pistache", "cpp", ("pistache",), (r"""Routes::(Get|Post|Put|Delete|Patch)\(\s*\w+\s*,\s*"([^"]+)\"""", 1, 2))
routes("cpp.oatpp", "cpp", ("oatpp",), (r"""ENDPOINT\(\s*"([A-Z]+)"\s*,\s*"([^"]+)\"""", 1, 2))
routes("cpp.cpprestsdk", "cpp", ("cpprest",), (r"""\.support\(\s*methods::(GET|POST|PUT|DEL|PATCH)""", 1, 1))


@register("ts.nextjs", "typescript javascript", "next")
def next_routes(path: str, text: str) -> Iterator[dict]:
    """A route for each page file, from its place in the tree."""
    m = re.search(r"(?:^|/)(?:src/)?(?:pages/(.+?)|app/(?:(.+)/)?(?:page|route))\.(?:tsx?|jsx?)$", path)
    if m and not re.search(r"(^|/)_(app|document|error)\.", path):
        inner = re.sub(r"\([^)/]*\)/?", "", (m[1] if m[1] is not None else m[2]) or "")
        inner = re.sub(r"(^|/)index$", "", inner).strip("/")
        yield {"type": "frontend.route", "name": "/" + re.sub(r"\[+\.{0,3}(\w+)\]+", r":\1", inner), "line": 1, "confidence": 0.95, "hint": 1.0}


@register("ts.react_router", "typescript javascript", "react-router", "react-router-dom")
def react_routes(path: str, text: str) -> Iterator[dict]:
    for m in re.finditer(r"<Route\b[^>]*\bpath=(?:\{)?[\"'`]([^\"'`]+)[\"'`]|\bpath:\s*[\"'`]([^\"'`]+)[\"'`]", text):
        yield {"type": "frontend.route", "name": m[1] or m[2], "line": _line(text, m.start()), "confidence": 0.9, "hint": 1.0}


@register("ts.prisma", "typescript javascript", "@prisma/client")
def prisma_queries(path: str, text: str) -> Iterator[dict]:
    for m in re.finditer(r"\bprisma\.(\w+)\.(find\w+|create\w*|update\w*|delete\w*|upsert|count|aggregate|groupBy)\(", text):
        yield {"type": "orm.query", "name": f"{m[1]}.{m[2]}", "line": _line(text, m.start()), "confidence": 0.85, "hint": 1.0}


#: How each language makes a server or a client of a remote service.
GRPC = {"go": (r"\bRegister(\w+?)Server\(", r"\bNew(\w+?)Client\("), "python": (r"\badd_(\w+?)Servicer_to_server\(", r"\b(\w+?)Stub\("), "java": (r"\bextends\s+(\w+?)Grpc\.\w+ImplBase", r"\b(\w+?)Grpc\.new\w*Stub\("), "typescript": (r"\.addService\(\s*(\w+?)Service\b", r"\bnew\s+(\w+?)Client\("), "javascript": (r"\.addService\(\s*(\w+?)Service\b", r"\bnew\s+(\w+?)Client\(")}
for _language, (_server, _client) in GRPC.items():

    @register(f"{_language}.grpc", _language, "grpc", "google.golang.org/grpc", "io.grpc", "@grpc/grpc-js")
    def grpc_ends(path: str, text: str, server=_server, client=_client) -> Iterator[dict]:
        for type_, pattern in (("grpc.server", server), ("grpc.client", client)):
            for m in re.finditer(pattern, text):
                yield {"type": type_, "name": m[1], "line": _line(text, m.start()), "confidence": 0.85, "hint": 0.8}


@register("datastore.glue", "go python java javascript typescript rust cpp")
def stores(path: str, text: str) -> Iterator[dict]:
    """Stores that a connection string names."""
    for m in re.finditer(r"\b(postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|rediss|amqp|kafka|cassandra)://", text):
        yield {"type": "datastore.dependency", "name": m[1].split("+")[0].rstrip("s") if m[1] == "rediss" else m[1].split("+")[0], "line": _line(text, m.start()), "confidence": 0.8, "hint": 0.6}


@register("python.locust", "python", "locust")
def locust_calls(path: str, text: str) -> Iterator[dict]:
    for m in re.finditer(rf"\bself\.client\.({VERBS})\(\s*f?{QUOTED}", text):
        yield {"type": "http.client", "name": f"{m[1].upper()} {m[2]}", "line": _line(text, m.start()), "confidence": 0.85, "hint": 0.6}


#: How each language imports.
IMPORTS = {"python": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "go": r"(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$", "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)", "rust": r"(?m)^\s*(?:pub\s+)?use\s+(\w+)", "cpp": r"(?m)^\s*#include\s*[<\"]([\w./+-]+)[>\"]", "c": r"(?m)^\s*#include\s*[<\"]([\w./+-]+)[>\"]"}
IMPORTS["typescript"] = IMPORTS["javascript"] = r"""(?:\bfrom\s+|\brequire\(\s*|^\s*import\s+)["']([^"']+)["']"""


def imports(language: str, text: str) -> set[str]:
    return {next(g for g in m.groups() if g) for m in re.finditer(IMPORTS.get(language, r"(?!)"), text)}


def is_active(triggers: tuple[str, ...], signals: set[str]) -> bool:
    """No triggers, or one that is a signal or begins one up to a / or a dot."""
    return not triggers or any(s == t or s.startswith((t + "/", t + ".")) for t in triggers for s in signals)


def facts_of(files: DataFrame, dependencies: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """files(path, language, content) -> facts of all active enrichers; dependencies(path, dependency): what the file's project asks for."""
    chosen = [REGISTRY[k] for k in sorted(REGISTRY) if only is None or k in only]
    rows = files.select("path", "language", "content")
    if dependencies is not None:
        rows = rows.join(dependencies.groupBy("path").agg(F.collect_set("dependency").alias("asked")), "path", "left")
    else:
        rows = rows.withColumn("asked", F.lit(None).cast("array<string>"))

    def run(batches):
        for pdf in batches:
            out = set()
            for path, language, content, asked in zip(pdf["path"], pdf["language"], pdf["content"], pdf["asked"]):
                if content is None:
                    continue
                signals = imports(language, content) | set(asked if asked is not None else [])
                for e in chosen:
                    if language in e.languages and is_active(e.triggers, signals):
                        for f in e.read(path, content):
                            name = str(f.get("name") or "").strip()
                            if name and f.get("type"):
                                out.add((path, e.id, f["type"], name, int(f.get("line") or 1), min(1.0, max(0.0, float(f.get("confidence", 1.0)))), float(f.get("hint", 0.0))))
            yield pd.DataFrame(sorted(out), columns=[c.split()[0] for c in FACT_SCHEMA.split(", ")])

    return rows.mapInPandas(run, FACT_SCHEMA)


def load_specs(spark: SparkSession, path: str) -> list[dict]:
    """Token specifications from a JSON-lines file: id, type, tokens, and languages, triggers, path_tokens, tags where given."""
    out = []
    for row in spark.read.text(path).collect():
        if row[0].strip():
            spec = json.loads(row[0])
            if not spec.get("id") or not spec.get("type") or not spec.get("tokens"):
                raise ValueError(f"a specification lacks id, type or tokens: {row[0]}")
            out.append(spec)
    return out


def specified_facts(files: DataFrame, found: list[dict]) -> DataFrame:
    """files(path, language, content, signals) -> what specs.facts makes of specifications as load_specs returns them."""
    from arborlens.functions import specs

    names = [c.split()[0] for c in specs.SPECS.split(", ")]
    return specs.facts(files, files.sparkSession.createDataFrame([tuple(x.get(c) for c in names) for x in found], specs.SPECS))
