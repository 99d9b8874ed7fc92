"""Workspaces and diagrams as text: element and connector files, an architecture language, thumbnails, diffs of a working tree."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.sources.manifests import documents

# -- workspace files ---------------------------------------------------------


def load_workspace(elements: str, connectors: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Texts of an element and a connector file -> elements (ref, fields), placements (ref, parent, x, y, delta), connectors (ref, fields); _meta sections are left out."""
    read = lambda text: next((d for d in documents(text) if isinstance(d, dict)), {})
    found, places = [], []
    for ref, e in read(elements).items():
        if ref.startswith("_") or not isinstance(e, dict):
            continue
        found.append({"ref": ref, **{k: e.get(k) for k in ("name", "kind", "description", "technology", "file_path", "symbol", "view_name")}, "tags": list(e.get("tags") or []), "has_view": bool(e.get("has_view"))})
        for p in e.get("placements") or [{"parent": "root"}]:
            places.append({"ref": ref, "parent": p.get("parent") or "root", "x": float(p.get("position_x") or 0), "y": float(p.get("position_y") or 0), "delta": int(p.get("visibility_delta") or 0)})
    edges = [{"ref": ref, **{k: c.get(k) for k in ("view", "source", "target", "label", "description", "relationship")}, "direction": c.get("direction") or "forward"} for ref, c in read(connectors).items() if not ref.startswith("_") and isinstance(c, dict)]
    return found, places, edges


def _quote(value) -> str:
    if value is None or isinstance(value, (int, float)):
        return json.dumps(value)
    text = str(value)
    plain = re.fullmatch(r"[A-Za-z_][\w ./()-]*[\w)]|[A-Za-z]", text) and text.lower() not in ("true", "false", "null", "yes", "no")
    return text if plain else json.dumps(text, ensure_ascii=False)


def dump(rows: list[dict], key: str = "ref") -> str:
    """Rows as block YAML under their refs, sorted; empty fields left out. What load_workspace reads back."""
    out = []
    for row in sorted(rows, key=lambda r: r[key]):
        out.append(f"{row[key]}:")
        for name, value in row.items():
            if name == key or value in (None, "", [], {}):
                continue
            if isinstance(value, bool):
                out.append(f"  {name}: {str(value).lower()}")
            elif isinstance(value, list):
                out.append(f"  {name}:")
                for x in value:
                    if isinstance(x, dict):
                        first = True
                        for k, v in x.items():
                            out.append(f"    {'- ' if first else '  '}{k}: {_quote(v)}")
                            first = False
                    else:
                        out.append(f"    - {_quote(x)}")
            else:
                out.append(f"  {name}: {_quote(value)}")
    return "\n".join(out) + "\n" if out else ""


def merged_export(own: list[dict], generated: list[dict], before: dict[int, str]) -> list[dict]:
    """A workspace's own rows and newly generated ones (id, name, ...) as one list: refs generated before go, known ids keep theirs, new ones get a free slug."""
    gone = set(before.values())
    out = [r for r in own if r["ref"] not in gone]
    taken = {r["ref"] for r in out} | {before[g["id"]] for g in generated if g["id"] in before}
    for g in sorted(generated, key=lambda r: r["id"]):
        ref = before.get(g["id"])
        if ref is None:
            slug = re.sub(r"[^a-z0-9]+", "-", str(g["name"]).lower()).strip("-") or "unknown"
            ref, n = slug, 1
            while ref in taken:
                n += 1
                ref = f"{slug}-{n}"
            taken.add(ref)
        out.append({"ref": ref, **{k: v for k, v in g.items() if k != "id"}})
    return sorted(out, key=lambda r: r["ref"])


def workspace_hash(rows: list[dict]) -> str:
    """A hash of rows that does not depend on their order or on positions."""
    bare = [{k: v for k, v in sorted(r.items()) if k not in ("x", "y", "position_x", "position_y")} for r in sorted(rows, key=lambda r: str(r.get("ref")))]
    return hashlib.sha256(json.dumps(bare, sort_keys=True, default=str).encode()).hexdigest()


# -- an architecture language ------------------------------------------------

_TOKEN = re.compile(r'\s+|//[^\n]*|#[^\n]*|/\*.*?\*/|("(?:[^"\\]|\\.)*")|(->|[{}=])|([^\s{}"=]+)', re.S)
#: Words that open an element, and the kind each makes.
ELEMENTS = {"person": "person", "softwaresystem": "system", "container": "container", "component": "component", "deploymentnode": "node", "infrastructurenode": "node", "element": "element"}
SCOPES = {"workspace", "model", "group", "enterprise"}


def architecture(text: str) -> tuple[list[dict], list[dict], list[str]]:
    """Architecture text -> elements (ref, kind, name, description, technology, parent, tags), relationships (source, target, label, technology), warnings.

    Scopes nest; a relationship without a source starts at the element around it; names are resolved when all are known, a relationship to an unknown one is a warning.
    """
    tokens = []
    for m in _TOKEN.finditer(text):
        if m[1]:
            tokens.append(("text", m[1][1:-1].replace('\\"', '"')))
        elif m[2] or m[3]:
            tokens.append(("mark" if m[2] else "word", m[2] or m[3]))
    elements, links, warnings = [], [], []
    at, refs = 0, {}

    def peek(k=0):
        return tokens[at + k] if at + k < len(tokens) else ("end", "")

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def texts():
        out = []
        while peek()[0] == "text":
            out.append(take()[1])
        return out

    def skip():
        depth = 0
        while at < len(tokens):
            _, t = take()
            depth += (t == "{") - (t == "}")
            if depth <= 0:
                return

    def body(parent):
        while at < len(tokens):
            if peek() == ("mark", "}"):
                take()
                return
            statement(parent)

    def statement(parent):
        kind, word = take()
        if kind != "word":
            if (kind, word) == ("mark", "->"):
                target = take()[1]
                links.append({"source": parent, "target": target, "said": texts()})
                if peek() == ("mark", "{"):
                    skip()
            return
        if peek() == ("mark", "->"):
            take()
            target = take()[1]
            links.append({"source": word, "target": target, "said": texts()})
            if peek() == ("mark", "{"):
                skip()
            return
        ref = None
        if peek() == ("mark", "=") and peek(1)[0] == "word":
            take()
            ref, word = word, take()[1]
        low = word.lower()
        if low in ELEMENTS:
            said = texts()
            ref = ref or re.sub(r"[^a-z0-9]+", "-", (said[0] if said else word).lower()).strip("-")
            if ref in refs:
                warnings.append(f"{ref} is defined twice")
            holds = low in ("container", "component")
            row = {"ref": ref, "kind": ELEMENTS[low], "name": said[0] if said else ref, "description": said[1] if len(said) > 1 else None, "technology": said[2] if holds and len(said) > 2 else None, "parent": parent, "tags": [x.strip() for x in (said[3] if holds and len(said) > 3 else said[2] if not holds and len(said) > 2 else "").split(",") if x.strip()]}
            refs[ref] = row
            elements.append(row)
            if peek() == ("mark", "{"):
                take()
                body(ref)
        elif low in SCOPES:
            texts()
            if peek() == ("mark", "{"):
                take()
                body(parent)
        elif low in ("description", "technology", "tags") and parent in refs:
            said = texts()
            if said:
                refs[parent][low] = [x.strip() for t in said for x in t.split(",") if x.strip()] if low == "tags" else said[0]
        else:
            texts()
            if peek() == ("mark", "{"):
                skip()

    while at < len(tokens):
        if peek() == ("mark", "}"):
            take()
        else:
            statement(None)
    out = []
    for link in links:
        ends = [link["source"], link["target"].rsplit(".", 1)[-1] if link["target"] not in refs else link["target"]]
        if ends[0] not in refs and ends[0]:
            ends[0] = ends[0].rsplit(".", 1)[-1]
        if None in ends or any(e not in refs for e in ends):
            warnings.append(f"{link['source']} -> {link['target']}: unknown")
            continue
        said = link["said"]
        out.append({"source": ends[0], "target": ends[1], "label": said[0] if said else None, "technology": said[1] if len(said) > 1 else None})
    return elements, out, warnings


# -- working tree ------------------------------------------------------------


def hunks(diff: str) -> list[dict]:
    """A unified diff as changed lines: file, change_type, added and removed line numbers."""
    out, file, a, b = [], None, 0, 0
    for line in diff.splitlines():
        if line.startswith("diff --git "):
            file = {"file": line.rsplit(" b/", 1)[-1], "change_type": "updated", "added": [], "removed": []}
            out.append(file)
        elif file is None:
            continue
        elif line.startswith("new file"):
            file["change_type"] = "added"
        elif line.startswith("deleted file"):
            file["change_type"] = "deleted"
        elif m := re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", line):
            a, b = int(m[1]), int(m[2])
        elif line.startswith("+") and not line.startswith("+++"):
            file["added"].append(b)
            b += 1
        elif line.startswith("-") and not line.startswith("---"):
            file["removed"].append(a)
            a += 1
        elif line.startswith(" "):
            a, b = a + 1, b + 1
    return out


def tree_status(text: str) -> list[tuple[str, str]]:
    """Short status lines as (path, tag)."""
    out = []
    for line in text.splitlines():
        if len(line) < 4:
            continue
        x, y, path = line[0], line[1], line[3:].split(" -> ")[-1].strip('"')
        if line.startswith("??"):
            out.append((path, "git:untracked"))
            continue
        if "D" in (x, y):
            out.append((path, "watch:deleted"))
        if x not in " ?D":
            out.append((path, "git:staged"))
        if y not in " ?D":
            out.append((path, "git:unstaged"))
    return out


def blob_hash(content: bytes) -> str:
    """The id that version control gives a file's content."""
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


# -- views out ---------------------------------------------------------------


def bundle(elements: DataFrame, placements: DataFrame, connectors: DataFrame, tree: DataFrame, navigations: DataFrame) -> DataFrame:
    """One row for each view of tree(view_id, depth, path): its place in the tree, its elements, its number of connectors and where it leads."""
    e = placements.join(elements.select(F.col("id").alias("element_id"), "name"), "element_id").groupBy("view_id").agg(F.array_sort(F.collect_list(F.struct(F.col("element_id").alias("id"), "name"))).alias("elements"))
    c = connectors.groupBy("view_id").agg(F.count("*").alias("connectors"))
    n = navigations.groupBy(F.col("from_view_id").alias("view_id")).agg(F.array_sort(F.collect_set("to_view_id")).alias("leads_to"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return tree.join(e, "view_id", "left").join(c, "view_id", "left").join(n, "view_id", "left").select("view_id", "depth", "path", none("elements", "array<struct<id:bigint,name:string>>").alias("elements"), F.coalesce("connectors", F.lit(0)).alias("connectors"), none("leads_to", "array<bigint>").alias("leads_to"))


def thumbnails(boxes: DataFrame, edges: DataFrame, width: int = 200, height: int = 100) -> DataFrame:
    """boxes(view_id, element_id, x, y), edges(view_id, source_element_id, target_element_id) -> view_id, svg: a line for each edge, a rectangle for each box, in the box that bounds them."""
    mid = lambda p: boxes.select("view_id", F.col("element_id").alias(f"{p}_element_id"), (F.col("x") + width // 2).cast("long").alias(f"{p}x"), (F.col("y") + height // 2).cast("long").alias(f"{p}y"))
    line = F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d"/>', "sx", "sy", "tx", "ty")
    drawn = edges.join(mid("source").withColumnsRenamed({"sourcex": "sx", "sourcey": "sy"}), ["view_id", "source_element_id"]).join(mid("target").withColumnsRenamed({"targetx": "tx", "targety": "ty"}), ["view_id", "target_element_id"])
    lines = drawn.select("view_id", line.alias("l")).groupBy("view_id").agg(F.array_join(F.array_sort(F.collect_set("l")), "").alias("lines"))
    rect = F.format_string(f'<rect x="%d" y="%d" width="{width}" height="{height}"/>', F.col("x").cast("long"), F.col("y").cast("long"))
    g = boxes.groupBy("view_id").agg(F.array_join(F.array_sort(F.collect_list(rect)), "").alias("rects"), F.min("x").cast("long").alias("a"), F.min("y").cast("long").alias("b"), (F.max("x") - F.min("x") + width).cast("long").alias("w"), (F.max("y") - F.min("y") + height).cast("long").alias("h"))
    svg = F.concat(F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="%d %d %d %d">', "a", "b", "w", "h"), F.coalesce("lines", F.lit("")), "rects", F.lit("</svg>"))
    return g.join(lines, "view_id", "left").select("view_id", svg.alias("svg"))


def save_vectors(vectors: DataFrame, path: str, model: str) -> None:
    """vectors(owner, input_hash, vector) into the partition of their model: a table that cache_misses and knn read."""
    vectors.withColumn("model", F.lit(model)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)
