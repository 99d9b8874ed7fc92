"""Scalar, text and vector functions as Column expressions (family F)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal lengths or a zero norm; computed in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def identifier_tokens(c: Column) -> Column:
    """Parts at _ - . and before capitals, lower case, distinct, sorted."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([A-Z])", " $1"), r"[_\-.\s]+", " ")
    # No function is called for each part: those with a lambda, as array_sort, are interpreted.
    return F.sort_array(F.array_remove(F.array_distinct(F.split(F.lower(spaced), " ")), ""))


def lexical_tokens(c: Column) -> Column:
    """Identifiers, numbers (as number_lit) and quoted strings (as string_lit), lower case."""
    found = F.regexp_extract_all(c, F.lit(r"""("[^"]*"|'[^']*'|[A-Za-z_][A-Za-z0-9_]*|[0-9]+)"""), 1)
    return F.transform(found, lambda t: F.when(t.rlike("^[\"']"), "string_lit").when(t.rlike("^[0-9]"), "number_lit").otherwise(F.lower(t)))


def char_ngrams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def feature_index(c: Column, dim: int) -> Column:
    """Little-endian uint32 of the first four SHA-256 bytes, modulo dim."""
    h = F.sha2(c, 256)
    flipped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(flipped, 16, 10).cast("long") % dim


def feature_sign(c: Column) -> Column:
    return F.when(F.conv(F.substring(F.sha2(c, 256), 9, 2), 16, 10).cast("int") % 2 == 1, -1).otherwise(1)


def token_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def approximate_tokens(c: Column) -> Column:
    """The larger of a quarter of the bytes, rounded up, and the number of words."""
    return F.greatest(F.ceil(F.octet_length(c) / 4), F.regexp_count(c, F.lit(r"\S+")).cast("long"))


def endpoint_host(c: Column) -> Column:
    """Host of a URL or host:port, lower case, without user, port and path."""
    rest = F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return F.lower(F.regexp_replace(F.regexp_replace(rest, r"^[^/@]*@", ""), r"[:/?#].*$", ""))


def direction(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("backward", "reverse", "in"), "backward").when(low.isin("both", "bidirectional"), "both").when(low == "none", "none").otherwise("forward")


def reverse_direction(c: Column) -> Column:
    return F.when(c == "forward", "backward").when(c == "backward", "forward").otherwise(c)


def glob_regex(pattern: str) -> str:
    """A segment-wise glob as an anchored regular expression: * and ? stop at /, ** does not."""
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def json_field(c: Column, name: str, kind: str, default: Column) -> Column:
    """A field of a JSON object; the default where the text is no JSON, or the field is missing or no such value."""
    return F.coalesce(F.get_json_object(c, f"$.{name}").try_cast(kind), default)
