"""Names, keys, tags and labels as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlens.functions.text import slug

#: Words that say what role a service name has.
ROLE_WORDS = ["service", "svc", "api", "db", "database", "store", "client", "server", "worker", "gateway", "adapter", "controller", "handler"]
#: Role tags and the words that call for them.
ROLE_RULES = {
    "role:watch": ["watch", "watcher", "scan", "scanner", "represent", "materializ", "embedding"],
    "role:cli": ["cmd/", "/cmd/", "cli", "command", "cobra"],
    "role:api": ["api", "http", "server", "handler", "route", "rpc", "websocket"],
    "role:persistence": ["store", "db", "database", "sqlite", "migration", "schema", "repository"],
    "role:ui": ["frontend", "component", "view", "react", "canvas", "zui"],
    "role:analysis": ["analyzer", "symbol", "parser", "importer", "planner", "dependency"],
    "role:versioning": ["git", "version", "history", "commit", "branch"],
    "role:config": ["config", "setting", "option", "threshold"],
    "role:test": ["test", "_test.go", "fixture", "mock"],
}
#: Words that mark a utility, folders that only lay out a tree, words that mark structure.
UTILITY_WORDS = ["log", "logger", "metric", "trace", "debug", "helper", "util"]
LAYOUT_FOLDERS = ["app", "apps", "cmd", "internal", "lib", "libs", "pkg", "packages", "service", "services", "source", "src"]
STRUCTURE_WORDS = ["if", "for", "while", "switch", "match", "try", "catch", "except", "return", "yield", "throw", "raise", "defer", "go"]


def any_of(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def exported(name: Column) -> Column:
    """The first character is upper case."""
    return F.coalesce(name, F.lit("")).rlike(r"^\p{Lu}")


def utility(name: Column, path: Column) -> Column:
    """The name, or its file's, holds a word of utilities."""
    return any_of(F.lower(name), UTILITY_WORDS) | any_of(F.lower(base_name(path)), UTILITY_WORDS)


def name_tokens(c: Column) -> Column:
    """Lower-case tokens: cut at other characters, before capitals, around digits, and before a role word that ends a token."""
    spaced = F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    words = F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")
    ends = "|".join(sorted(ROLE_WORDS, key=len, reverse=True))
    return F.flatten(F.transform(words, lambda t: F.split(F.regexp_replace(t, f"^(.+?)({ends})$", "$1 $2"), " ")))


def service_root(c: Column, least: int = 3) -> Column:
    """The tokens that are no role words, joined by -; null if there are none or fewer than `least` characters."""
    root = F.array_join(F.filter(name_tokens(c), lambda t: ~t.isin(ROLE_WORDS)), "-")
    return F.when(F.length(root) >= max(1, least), root)


def architecture_slug(c: Column) -> Column:
    s = slug(c)
    return F.when(s == "", "unknown").otherwise(s)


def tag_value(c: Column) -> Column:
    """A slug that spells & and + out and drops dots."""
    s = F.lower(F.trim(c))
    for old, new in ((" / ", "-"), ("/", "-"), (" ", "-"), ("&", "and"), (".", ""), ("+", "plus")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.btrim(F.regexp_replace(s, "-{2,}", "-"), F.lit("-"))


def role_tags(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(any_of(low, words), tag) for tag, words in ROLE_RULES.items()]))


def area_tag(path: Column) -> Column:
    """The first folder of a path; null for a bare file."""
    trimmed = F.btrim(path, F.lit("/"))
    return F.when(F.contains(trimmed, F.lit("/")), F.concat(F.lit("area:"), slug(F.split_part(trimmed, F.lit("/"), F.lit(1)))))


def prefixed_tag(prefix: str, c: Column, none: tuple[str, ...] = ()) -> Column:
    low = F.lower(F.trim(c))
    return F.when((low != "") & ~low.isin("", *none), F.concat(F.lit(f"{prefix}:"), slug(low)))


def graph_tags(name: Column, incoming: Column, outgoing: Column) -> Column:
    return F.array_compact(F.array(F.when(exported(name), "graph:entrypoint"), F.when(incoming >= 3, "graph:fan-in"), F.when(outgoing >= 3, "graph:fan-out")))


#: How much a file tells about an architecture, by what its name and its path hold (lower case); the first that fits counts.
PATH_SCORES = [
    (100, r"^dockerfile($|\.)", ""),
    (100, r"^docker-compose.*\.ya?ml$", ""),
    (95, r"^(kustomization\.yaml|kustomization\.yml|chart\.yaml|values\.yaml)$", ""),
    (90, "", r"\.github/workflows/"),
    (90, r"^codeowners$", ""),
    (85, r"^(package\.json|package-lock\.json|pnpm-lock\.yaml|yarn\.lock|go\.mod|go\.sum|pom\.xml|build\.gradle|settings\.gradle|requirements\.txt|requirements\.in|pyproject\.toml|poetry\.lock|cargo\.toml)$", ""),
    (80, r"\.(tf|proto)$", ""),
    (70, r"^readme", ""),
    (88, r"\.ya?ml$", r"k8s|kubernetes|deploy|manifest"),
    (40, r"\.ya?ml$", ""),
    (60, r"^(main\.go|server\.go|app\.ts|app\.tsx|index\.ts|index\.tsx)$", ""),
]


def path_score(path: Column) -> Column:
    """How much a file tells about an architecture, 0 to 100."""
    base, low = F.lower(base_name(path)), F.lower(path)
    out = F.lit(0)
    for score, name, place in reversed(PATH_SCORES):
        out = F.when(base.rlike(name) & low.rlike(place), score).otherwise(out)
    return out


def component_of_path(path: Column) -> Column:
    """The innermost folder that does not only lay out a tree."""
    folders = F.filter(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda p: ~F.lower(F.trim(p)).isin(LAYOUT_FOLDERS) & ~F.trim(p).isin("", "."))
    return F.try_element_at(folders, F.lit(-1))


def endpoint_name(c: Column) -> Column:
    """A host's first label as a name: without scheme, port and domain; templates and variables have none."""
    v = F.btrim(F.btrim(F.lower(c)), F.lit("\"'"))
    rest = F.regexp_replace(v, r"^.*?://", "")
    label = F.btrim(F.split_part(F.split_part(rest, F.lit(":"), F.lit(1)), F.lit("."), F.lit(1)), F.lit("/"))
    name = F.btrim(F.regexp_replace(label, "[^a-z0-9-]+", "-"), F.lit("-"))
    return F.when(~F.contains(v, F.lit("{{")) & ~v.startswith("$") & (name != ""), name)


def path_of_stable_key(key: Column) -> Column:
    """kind:path:name:rest -> path; null with fewer than four parts."""
    parts = F.split(key, ":", 4)
    return F.when((F.size(parts) == 4) & (F.trim(parts[1]) != ""), parts[1])


def paths_of_pair(key: Column) -> Column:
    """a->b -> [a, b]; null unless there are two parts."""
    parts = F.split(key, "->")
    return F.when(F.size(parts) == 2, F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def fact_summary_identity(key: Column) -> Column:
    """fact-summary:file:type[:hash] -> struct(file, type)."""
    rest = F.regexp_replace(key, "^fact-summary:", "")
    rest = F.regexp_replace(rest, "^(.+:.+):[0-9a-f]{16,}$", "$1")
    return F.when(key.startswith("fact-summary:") & F.contains(rest, F.lit(":")), F.struct(F.regexp_extract(rest, "^(.*):[^:]*$", 1).alias("file"), F.regexp_extract(rest, "([^:]*)$", 1).alias("type")))


def indent_width(line: Column) -> Column:
    """Width of the leading white space, a tab as four."""
    lead = F.regexp_extract(line, "^([ \t]*)", 1)
    return F.length(F.replace(lead, F.lit("\t"), F.lit("    ")))


def structural_tokens(text: Column) -> Column:
    """For each line that is not blank: the words of structure it holds, in fixed order, and its indent in steps of four."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    one = lambda x: F.concat(F.array_compact(F.array(*[F.when(F.contains(F.trim(x), F.lit(w)), w) for w in STRUCTURE_WORDS])), F.array(F.concat(F.lit("indent:"), F.floor(indent_width(x) / 4).cast("string"))))
    return F.flatten(F.transform(lines, one))


def outdented(text: Column) -> Column:
    """Strip the white space that all lines with ink begin with."""
    lines = F.split(text, "\n")
    common = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(x, "^([ \t]*)", 1))))
    return F.array_join(F.transform(lines, lambda x: F.when(F.btrim(x) == "", "").otherwise(F.substr(x, F.coalesce(common, F.lit(0)) + 1))), "\n")


def line_range(text: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), max(1, first), max(0, last - max(1, first) + 1)), "\n")


def normalised_content(text: Column, name: Column) -> Column:
    """Outdented, trimmed, with the own name replaced: equal bodies of renamed symbols are equal."""
    body = F.btrim(outdented(text), F.lit(" \t\r\n"))
    return F.when(name == "", body).otherwise(F.replace(body, name, F.lit("__symbol__")))


def proxy_label(n: Column, labels: Column, first: Column) -> Column:
    """One connector: its label; several of one label: 'n × label'; else 'n connectors'. labels: the distinct ones."""
    many = F.when(F.size(labels) == 1, F.concat(n.cast("string"), F.lit(" × "), labels[0])).otherwise(F.concat(n.cast("string"), F.lit(" connectors")))
    return F.when(n == 1, F.coalesce(first, F.lit("Cross-view"))).otherwise(many)


def stat_line(label: str, changed: Column, initialized: Column, added: Column, removed: Column) -> Column:
    """'2 views changed, 1 view initialized, +3, -1'."""
    plural = lambda n, what: F.concat(n.cast("string"), F.when(n == 1, f" {label} {what}").otherwise(f" {label}s {what}"))
    first = F.when(changed > 0, plural(changed, "changed"))
    second = F.when(initialized > 0, plural(initialized, "initialized"))
    none = F.when((changed <= 0) & (initialized <= 0), f"0 {label}s changed")
    return F.concat_ws(", ", first, second, none, F.when(added > 0, F.concat(F.lit("+"), added.cast("string"))), F.when(removed > 0, F.concat(F.lit("-"), removed.cast("string"))))


#: Technologies that say nothing of a family.
PLAIN_TECHNOLOGIES = ["runtime", "container", "kubernetes", "docker-compose"]


def component_class(kind: Column) -> Column:
    return F.when(kind.isin("datastore", "queue", "external", "interface"), kind).otherwise("component")


def dependency_family(kind: Column, name: Column, technology: Column, tags: Column) -> Column:
    """What a dependency is one of: its datastore: or external: tag, else its technology, else (of a dependency) its name."""
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    tagged = F.try_element_at(F.filter(F.transform(low, lambda t: F.regexp_extract(t, "^(?:datastore|external):(.+)$", 1)), lambda t: t != ""), F.lit(1))
    tech = slug(F.coalesce(technology, F.lit("")))
    own = F.when(kind.isin("datastore", "queue", "external"), F.when(tech != "", tech).otherwise(slug(name))).when((tech != "") & ~tech.isin(PLAIN_TECHNOLOGIES), tech)
    return F.coalesce(slug(tagged), own)


def unique_in_order(values: Column) -> Column:
    """Trimmed strings that hold something, each once, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def united(first: Column, second: Column, most: int | None = None) -> Column:
    """Both lists, the first one's entries before, each once; the first `most` of them."""
    none = F.array().cast("array<string>")
    both = unique_in_order(F.concat(F.coalesce(first, none), F.coalesce(second, none)))
    return both if most is None else F.slice(both, 1, most)


def endpoint(value: Column) -> Column:
    """An environment value as struct(host, port, protocol): of a URL or name:port; null fields where there are none."""
    v = F.trim(value)
    scheme = F.lower(F.regexp_extract(v, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    rest = F.regexp_replace(F.regexp_replace(v, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"^[^/@]*@", "")
    port = F.regexp_extract(rest, r"^[^/:]+:(\d{1,5})", 1)
    host = F.lower(F.regexp_extract(rest, r"^([A-Za-z0-9][A-Za-z0-9.\-]*)", 1))
    ok = (scheme != "") | (port != "")
    filled = lambda c: F.when(ok & (c != ""), c)
    return F.struct(filled(host).alias("host"), filled(port).cast("int").alias("port"), filled(scheme).alias("protocol"))


def clamped(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def effective_maximum(base: int, tier: Column, step: float = 0.25, most: float = 2.0) -> Column:
    """How many a view may hold at a tier: the base, `step` more for each tier, `most` times the base at most."""
    return F.floor(base * F.least(F.lit(most), 1 + step * F.greatest(F.coalesce(tier, F.lit(0)), F.lit(0)))).cast("long")
