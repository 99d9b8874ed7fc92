"""Manifests as facts: compose files, cluster objects, service contracts, API descriptions, infrastructure, dependency lists.

Each parser takes the text of one file and gives fact rows; files(path, content) are parsed in
Arrow batches, one file at a time. A file that does not parse gives none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

FACT_SCHEMA = "path string, type string, name string, source string, target string, kind string, technology string, label string, relationship string, confidence double, line long"
FIELDS = ["type", "name", "source", "target", "kind", "technology", "label", "relationship", "confidence", "line"]
#: Image and resource names that stand for stores and queues.
STORES = {"postgres": "PostgreSQL", "mysql": "MySQL", "mariadb": "MariaDB", "mongo": "MongoDB", "redis": "Redis", "elasticsearch": "Elasticsearch", "cassandra": "Cassandra", "memcached": "Memcached"}
QUEUES = {"kafka": "Kafka", "rabbitmq": "RabbitMQ", "nats": "NATS", "activemq": "ActiveMQ"}
WORKLOADS = {"Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob", "Pod", "ReplicaSet"}


# -- a subset of YAML: block maps and lists, scalars, quotes, flow lists and maps, documents -------------


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "[{" and text[-1:] in "]}":
        return _flow(text)[0]
    if text[:1] in "\"'":
        return text[1:-1] if text[-1:] == text[:1] and len(text) > 1 else text
    low = text.lower()
    if low in ("", "~", "null"):
        return None
    if low in ("true", "false"):
        return low == "true"
    return int(text) if re.fullmatch(r"-?(0|[1-9]\d*)", text) else float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def _flow(text: str, at: int = 0):
    """A flow list or map that starts at a place: (value, place after it)."""
    close, out = ("]", []) if text[at] == "[" else ("}", {})
    at, key, held = at + 1, None, ""

    def add():
        nonlocal key, held
        if key is not None:
            out[key] = _scalar(held) if isinstance(held, str) else held
        elif held != "" and isinstance(out, list):
            out.append(_scalar(held) if isinstance(held, str) else held)
        key, held = None, ""

    while at < len(text):
        c = text[at]
        if c in "[{" and (held == "" or (isinstance(held, str) and not held.strip())):
            held, at = _flow(text, at)
            continue
        if c in "\"'" and isinstance(held, str) and not held.strip():
            end = text.find(c, at + 1)
            held, at = text[at : (end if end > 0 else len(text)) + 1], (end if end > 0 else len(text)) + 1
            continue
        if c == close:
            add()
            return out, at + 1
        if c == ",":
            add()
        elif c == ":" and close == "}" and key is None:
            key, held = str(_scalar(held)), ""
        elif isinstance(held, str):
            held += c
        at += 1
    add()
    return out, at


def _lines(text: str) -> list[tuple[int, str]]:
    out = []
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line) if "'" not in line and '"' not in line else line
        if bare.strip():
            out.append((len(bare) - len(bare.lstrip(" ")), bare.strip()))
    return out


_KEY = re.compile(r"""^("[^"]*"|'[^']*'|[^\s"'\[{#][^:]*?):(?:\s+(.*))?$""")


def _block(lines: list[tuple[int, str]], at: int, indent: int):
    """The map or list whose entries stand at this indent: (value, next line)."""
    is_list = lines[at][1].startswith("-")
    out: list | dict = [] if is_list else {}
    while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-") == is_list:
        depth, text = lines[at]
        if is_list:
            rest = text[1:].strip()
            inner = depth + 1 + len(text[1:]) - len(text[1:].lstrip())
            if not rest:
                value, at = _block(lines, at + 1, lines[at + 1][0]) if at + 1 < len(lines) and lines[at + 1][0] > depth else (None, at + 1)
            elif _KEY.match(rest) and rest[:1] not in "[{":
                lines[at] = (inner, rest)
                value, at = _block(lines, at, inner)
            else:
                value, at = _scalar(rest), at + 1
            out.append(value)
            continue
        m = _KEY.match(text)
        if not m:
            raise ValueError(text)
        key, rest = str(_scalar(m[1])), (m[2] or "").strip()
        if rest in ("|", ">", "|-", ">-"):
            at, held = at + 1, []
            while at < len(lines) and lines[at][0] > depth:
                held.append(lines[at][1])
                at += 1
            out[key] = ("\n" if rest[0] == "|" else " ").join(held)
        elif rest:
            out[key], at = _scalar(rest), at + 1
        elif at + 1 < len(lines) and (lines[at + 1][0] > depth or (lines[at + 1][0] == depth and lines[at + 1][1].startswith("-"))):
            out[key], at = _block(lines, at + 1, lines[at + 1][0])
        else:
            out[key], at = None, at + 1
    return out, at


def documents(text: str) -> list:
    """The documents of a block-style YAML text, or of a JSON one."""
    if text.lstrip()[:1] in ("{", "["):
        return [json.loads(text)]
    out = []
    for part in re.split(r"(?m)^---.*$", text):
        lines = _lines(part)
        if lines:
            value, at = _block(lines, 0, lines[0][0])
            if at < len(lines):
                raise ValueError(lines[at][1])
            out.append(value)
    return out


# -- parsers -----------------------------------------------------------------


def _fact(type_: str, **fields) -> dict:
    return {"type": type_, "confidence": 0.9, **fields}


def host_of(value) -> str | None:
    """The host that an environment value points to: a URL, or name:port."""
    text = str(value or "").strip()
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/]*@)?([A-Za-z0-9.\-]+)", text) or re.match(r"^([A-Za-z][A-Za-z0-9.\-]*):\d{2,5}(?:[/?].*)?$", text)
    return m[1].lower() if m and not text.startswith("$") else None


def kind_of_image(image) -> tuple[str, str]:
    base = str(image or "").rsplit("/", 1)[-1].split(":")[0].split("@")[0].lower()
    for kind, table in (("datastore", STORES), ("queue", QUEUES)):
        for name, technology in table.items():
            if name in base:
                return kind, technology
    return "service", base or "Container"


def _pairs(value) -> list[tuple[str, str]]:
    """Environment settings as (name, value), from a map or from a list of NAME=value."""
    if isinstance(value, dict):
        return [(str(k), "" if v is None else str(v)) for k, v in value.items()]
    return [tuple(str(x).split("=", 1)) if "=" in str(x) else (str(x), "") for x in value or []]


def compose(text: str) -> Iterator[dict]:
    """Services, what they depend on, hosts in their environment, ports and volumes."""
    for doc in documents(text):
        services = doc.get("services") if isinstance(doc, dict) else None
        for name, spec in (services or {}).items():
            spec = spec or {}
            kind, technology = kind_of_image(spec.get("image"))
            yield _fact("runtime.component", name=name, kind=kind, technology=technology)
            needs = spec.get("depends_on") or []
            for other in needs:
                yield _fact("runtime.connection", name=f"{name}->{other}", source=name, target=str(other), label="depends on")
            for key, value in _pairs(spec.get("environment")):
                if host := host_of(value):
                    yield _fact("runtime.endpoint_ref", name=key, source=name, target=host, confidence=0.78)
            for port in spec.get("ports") or []:
                inside = str(port.get("target") if isinstance(port, dict) else port).split("/")[0].rsplit(":", 1)[-1]
                yield _fact("runtime.endpoint", name=f"{inside}/tcp", target=name)
            for volume in spec.get("volumes") or []:
                outer = str(volume.get("source") if isinstance(volume, dict) else volume).split(":")[0]
                yield _fact("runtime.volume", name=outer, source=name, target=outer, label="mounts")


def _containers(spec: dict) -> list[dict]:
    spec = spec or {}
    for key in ("jobTemplate", "template"):
        if isinstance(spec.get(key), dict):
            return _containers(spec[key].get("spec") or {})
    return [c for c in spec.get("containers") or [] if isinstance(c, dict)]


def cluster(text: str) -> Iterator[dict]:
    """Workloads, services, ingresses and network policies."""
    for doc in documents(text):
        if not isinstance(doc, dict) or "kind" not in doc:
            continue
        name, kind, spec = (doc.get("metadata") or {}).get("name"), doc["kind"], doc.get("spec") or {}
        if not name:
            continue
        if kind in WORKLOADS:
            boxes = _containers(spec)
            what, technology = kind_of_image(boxes[0].get("image")) if boxes else ("service", "Kubernetes")
            yield _fact("runtime.component", name=name, kind=what, technology=technology)
            for box in boxes:
                for setting in box.get("env") or []:
                    if host := host_of((setting or {}).get("value")):
                        yield _fact("runtime.endpoint_ref", name=setting.get("name"), source=name, target=host, confidence=0.78)
        elif kind == "Service":
            app = next(iter((spec.get("selector") or {}).values()), None)
            for port in spec.get("ports") or []:
                yield _fact("runtime.endpoint", name=f"{port.get('port')}/{str(port.get('protocol') or 'tcp').lower()}", source=name, target=app or name)
        elif kind == "Ingress":
            for rule in spec.get("rules") or []:
                for path in ((rule.get("http") or {}).get("paths")) or []:
                    to = (((path.get("backend") or {}).get("service")) or {}).get("name") or (path.get("backend") or {}).get("serviceName")
                    if to:
                        yield _fact("runtime.connection", name=f"{rule.get('host') or '*'}{path.get('path') or '/'}", source=name, target=to, label="routes")
        elif kind == "NetworkPolicy":
            to = next(iter(((spec.get("podSelector") or {}).get("matchLabels") or {}).values()), None)
            for entry in spec.get("ingress") or []:
                for peer in entry.get("from") or []:
                    app = next(iter(((peer.get("podSelector") or {}).get("matchLabels") or {}).values()), None)
                    if app and to:
                        yield _fact("runtime.connection", name=name, source=app, target=to, label="allowed")


def contracts(text: str) -> Iterator[dict]:
    """Services and calls of a protocol file."""
    service, depth = None, 0
    for number, line in enumerate(re.sub(r"//[^\n]*", "", text).splitlines(), 1):
        if m := re.match(r"\s*service\s+(\w+)", line):
            service, depth = m[1], 0
            yield _fact("grpc.contract", name=service, kind="interface", technology="gRPC", line=number)
        if service and (m := re.match(r"\s*rpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)", line)):
            yield _fact("grpc.method", name=f"{service}.{m[1]}", source=m[2], target=m[3], line=number)
        depth += line.count("{") - line.count("}")
        if service and depth <= 0 and "}" in line:
            service = None


def api_description(text: str) -> Iterator[dict]:
    """Routes of an API description."""
    for doc in documents(text):
        if isinstance(doc, dict) and ("openapi" in doc or "swagger" in doc):
            for path, ops in (doc.get("paths") or {}).items():
                for method in ops or {}:
                    if str(method).lower() in ("get", "put", "post", "delete", "patch", "head", "options", "trace"):
                        yield _fact("http.route", name=f"{str(method).upper()} {path}")


def infrastructure(text: str) -> Iterator[dict]:
    """Resources of an infrastructure file, and references between them."""
    blocks = list(re.finditer(r'(?m)^resource\s+"([\w-]+)"\s+"([\w-]+)"\s*\{', text))
    names = {f"{m[1]}.{m[2]}" for m in blocks}
    for m, after in zip(blocks, [*blocks[1:], None]):
        own = f"{m[1]}.{m[2]}"
        kind = "datastore" if re.search(r"(_db|rds|dynamodb|s3|bucket|sql|redis|elasticache|storage)", m[1]) else "queue" if re.search(r"(sqs|sns|kafka|pubsub|queue|topic)", m[1]) else "external"
        yield _fact("runtime.component", name=m[2], kind=kind, technology=m[1], line=text[: m.start()].count("\n") + 1)
        body = text[m.end() : after.start() if after else len(text)]
        for other in sorted({f"{x[1]}.{x[2]}" for x in re.finditer(r"\b([a-z][\w]*)\.([\w-]+)\.", body)} & names - {own}):
            yield _fact("runtime.connection", name=f"{own}->{other}", source=m[2], target=other.split(".", 1)[1], label="uses", confidence=0.8)


def _toml_tables(text: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    table = ""
    for line in text.splitlines():
        if m := re.match(r"\s*\[+\s*([^\]]+?)\s*\]+\s*(?:#.*)?$", line):
            table = m[1]
        elif line.strip() and not line.strip().startswith("#"):
            out.setdefault(table, []).append(line.strip())
    return out


def dependencies(path: str, text: str) -> list[str]:
    """Names of the modules that a dependency list asks for, sorted."""
    base, found = path.rsplit("/", 1)[-1].lower(), set()
    if base == "go.mod":
        found = {m[1] for m in re.finditer(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./~-]+)\s+v\d", text)}
    elif base == "package.json":
        doc = json.loads(text)
        found = {k for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for k in doc.get(part) or {}}
    elif re.fullmatch(r"requirements[^/]*\.(txt|in)", base):
        found = {m[1].lower() for m in re.finditer(r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", re.sub(r"#.*", "", text))}
    elif base == "pyproject.toml":
        tables = _toml_tables(text)
        listed = " ".join(tables.get("project", []))
        if m := re.search(r"dependencies\s*=\s*\[(.*?)\](?=\s|$)", listed, re.S):
            found = {x[1].lower() for x in re.finditer(r"[\"']\s*([A-Za-z0-9][A-Za-z0-9._-]*)", m[1])}
        found |= {line.split("=")[0].strip(" \"'").lower() for line in tables.get("tool.poetry.dependencies", [])} - {"python"}
    elif base == "cargo.toml":
        found = {line.split("=")[0].strip() for t, lines in _toml_tables(text).items() if re.fullmatch(r"(.*\.)?(dev-|build-)?dependencies", t) for line in lines if "=" in line}
    elif base in ("build.gradle", "build.gradle.kts"):
        found = {f"{m[1]}:{m[2]}" for m in re.finditer(r"""(?m)^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation)\s*\(?\s*["']([^:"']+):([^:"']+)""", text)}
    elif base == "pom.xml":
        found = {f"{m[1].strip()}:{m[2].strip()}" for m in re.finditer(r"(?s)<dependency>.*?<groupId>(.*?)</groupId>.*?<artifactId>(.*?)</artifactId>.*?</dependency>", text)}
    elif base in ("conanfile.txt", "conanfile.py"):
        found = {m[1] for m in re.finditer(r"(?m)([A-Za-z0-9_.+-]+)/[\d][\w.+-]*(?=[@\s\"'#)]|$)", text)}
    return sorted(found)


def dependency_list(path: str) -> Callable[[str], Iterator[dict]]:
    def parse(text: str) -> Iterator[dict]:
        for name in dependencies(path, text):
            yield _fact("dependency.module", name=name, confidence=1.0)

    return parse


def parser_of(path: str) -> Callable[[str], Iterator[dict]] | None:
    """The parser for a file, by its name."""
    base = path.rsplit("/", 1)[-1].lower()
    if re.fullmatch(r"(docker-)?compose[\w.-]*\.ya?ml", base):
        return compose
    if base.endswith(".proto"):
        return contracts
    if base.endswith(".tf"):
        return infrastructure
    if re.search(r"(openapi|swagger)[\w.-]*\.(json|ya?ml)$", base):
        return api_description
    if re.fullmatch(r"go\.mod|package\.json|requirements[^/]*\.(txt|in)|pyproject\.toml|cargo\.toml|build\.gradle(\.kts)?|pom\.xml|conanfile\.(txt|py)", base):
        return dependency_list(path)
    return cluster if re.search(r"\.ya?ml$", base) else None


def manifest_facts(files: DataFrame) -> DataFrame:
    """files(path, content) -> the facts of all manifests among them."""

    def parse(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                parser = parser_of(path)
                if parser is None or content is None:
                    continue
                try:
                    found = list(parser(content))
                except (ValueError, AttributeError, TypeError, IndexError):
                    continue
                out += [(path, *(f.get(k) for k in FIELDS)) for f in found]
            yield pd.DataFrame(out, columns=["path", *FIELDS]).astype({"confidence": float, "line": "Int64"})

    return files.select("path", "content").mapInPandas(parse, FACT_SCHEMA)
