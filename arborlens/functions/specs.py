"""Token specifications as a relation (U2, U4): every token of every specification is looked for in one pass of each text.

The distinct tokens go into an Aho-Corasick automaton that each task builds for itself; its cost for a text does not depend on how many specifications there are. Tokens of more than
TOKEN_BYTES in all are dealt over several automata, each a pass. A text yields one row with the tokens that it holds. Specifications that are alike but for id, type and tags are members of one kind,
which is looked at once for a text. Kinds are dealt into cells of about CELL_TOKENS listed tokens; a task holds a cell and the texts pass by it. It tells, for each kind, its members and what holds it;
their product, in which every pair of a text and a specification may be a fact, is unfolded as it leaves and is never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.functions.enrich import without_comments
from arborlens.operators.graph import stored

TOKEN_BYTES = 8 << 20
CELL_TOKENS = 1 << 16
#: Members that take the memory of a listed token, about; the most in a row, about; pairs of a path and a kind in an output batch, about; and facts that one row unfolds to, which Spark holds until all are made.
LIGHT, MEMBERS, PAIRS, FACTS = 8, 1 << 8, 1 << 19, 1 << 13
#: Confidence and visibility hint of such a fact.
CONFIDENCE, HINT = 0.78, 0.6

SPECS = "id string, type string, tokens array<string>, languages array<string>, triggers array<string>, path_tokens array<string>, tags array<string>"


def held_tokens(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """texts(code, ...), tokens(token) -> the other columns of texts, and tokens: the different ones that the text holds; overlaps count. No row for a text without any; one for each pass that finds some."""
    distinct = tokens.where("token <> ''").select("token").distinct()
    size = distinct.agg(F.sum(F.octet_length("token") + 8)).first()[0] or 0
    passes = -(-size // TOKEN_BYTES)
    rest = texts.drop("code")
    shape, kept = rest.withColumn("tokens", F.array(F.lit(""))).schema, rest.columns
    out = None
    for k in range(passes):
        # Bounded: TOKEN_BYTES in each pass on average.
        words = sorted(r[0] for r in distinct.where(F.pmod(F.xxhash64("token"), F.lit(passes)) == k).collect())

        def run(batches: Iterator[pa.RecordBatch], words=words, kept=tuple(kept)) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in words:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for b in batches:
                found = [sorted({w for _, w in automaton.iter(text)}) if text else [] for text in b.column("code").to_pylist()]
                take = pa.array([i for i, ws in enumerate(found) if ws], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in kept), pa.array([ws for ws in found if ws], pa.list_(pa.string()))], [*kept, "tokens"])

        if words:
            one = texts.select(*kept, "code").mapInArrow(run, shape)
            out = one if out is None else out.unionByName(one)
    return out if out is not None else rest.withColumn("tokens", F.array(F.lit(""))).where("false")


class _Cell:
    """The kinds of a cell, from rows (tokens, languages, triggers, path_tokens, members)."""

    def __init__(self, rows: pa.Table):
        listed = lambda name: [[x for x in v or [] if x is not None] for v in rows.column(name).to_pylist()]
        self.members, n = rows.column("members").combine_chunks(), rows.num_rows
        self.held = np.maximum(1, FACTS // self.members.value_lengths().to_numpy())
        tokens = rows.column("tokens").to_pylist()
        sizes = np.fromiter((len(x) for x in tokens), np.int64, n)
        self.words = pa.array([w for x in tokens for w in x], pa.string())
        self.owner = np.repeat(np.arange(n), sizes)
        by: dict[str, list[int]] = {}
        for i, w in enumerate(self.words.to_pylist()):
            by.setdefault(w, []).append(i)
        self.at = {w: np.array(i) for w, i in by.items()}
        self.by_language, self.any_language = self._named(rows.column("languages").to_pylist(), listed("languages"))
        self.by_trigger, self.any_trigger = self._named(rows.column("triggers").to_pylist(), listed("triggers"))
        kinds: dict[tuple, int] = {}
        whole = rows.column("path_tokens").to_pylist()
        self.kind = np.array([kinds.setdefault(tuple(v) if v else (), len(kinds)) for v in whole], np.int64)
        self.kinds = list(kinds)

    @staticmethod
    def _named(whole: list, listed: list) -> tuple[dict, np.ndarray]:
        by: dict[str, list[int]] = {}
        for i, names in enumerate(listed):
            for x in set(names):
                by.setdefault(x, []).append(i)
        return {x: np.array(i) for x, i in by.items()}, np.array([not v for v in whole], bool)

    def hits(self, path, language, signals, tokens) -> np.ndarray:
        """Places (in words) of the tokens that the text holds, of kinds that apply to it."""
        found = [self.at[w] for w in tokens if w in self.at]
        if not found:
            return np.zeros(0, np.int64)
        at = np.concatenate(found)
        ok = self.any_language.copy()
        if language in self.by_language:
            ok[self.by_language[language]] = True
        told = self.any_trigger.copy()
        for s in signals or []:
            for t in [s, *(s[:i] for i, c in enumerate(s) if c in "/.")] if s is not None else []:
                if t in self.by_trigger:
                    told[self.by_trigger[t]] = True
        at = at[(ok & told)[self.owner[at]]]
        kind = self.kind[self.owner[at]]
        fits = np.zeros(len(self.kinds), bool)
        for k in np.unique(kind).tolist():
            fits[k] = not self.kinds[k] or (path is not None and any(t is not None and t in str(path) for t in self.kinds[k]))
        return at[fits[kind]]


KIND = ["tokens", "languages", "triggers", "path_tokens", "members"]


def _facts_of(cell: _Cell, found: list[tuple], path_type: pa.DataType) -> pa.RecordBatch:
    """found: (path, places of the first listed tokens) -> rows for each kind: its members, and the paths and names of its facts, so many that a row unfolds to FACTS at most."""
    places = np.concatenate([x[1] for x in found])
    owner = cell.owner[places]
    order = np.argsort(owner, kind="stable")
    places, owner = places[order], owner[order]
    begins = np.concatenate([[True], owner[1:] != owner[:-1]])
    at = np.arange(len(owner)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
    cuts = np.flatnonzero(at % cell.held[owner] == 0)
    row = np.repeat(np.arange(len(found)), [len(x[1]) for x in found])[order]
    told = pa.StructArray.from_arrays([pa.array([x[0] for x in found], path_type).take(pa.array(row)), cell.words.take(pa.array(places))], ["path", "name"])
    return pa.RecordBatch.from_arrays([cell.members.take(pa.array(owner[cuts])), pa.ListArray.from_arrays(pa.array(np.append(cuts, len(owner)), pa.int32()), told)], ["members", "held"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, role, path, ...) sorted by cell, role and path: a cell's kinds, then the texts -> members and held. Rows of one path hold a kind once."""
    number, parts, cell, path, path_type, at, found, pairs = None, [], None, None, None, [], [], 0

    def closed() -> int:
        if not at:
            return 0
        places = np.unique(np.concatenate(at))
        # Words stand by kind and place, so the first of each is the first listed.
        found.append((path, places[np.unique(cell.owner[places], return_index=True)[1]]))
        at.clear()
        return len(found[-1][1])

    for b in batches:
        on, role, path_type = b.column("cell").to_numpy(), b.column("role").to_numpy(), b.schema.field("path").type
        cuts = np.flatnonzero(np.concatenate([[True], (on[1:] != on[:-1]) | (role[1:] != role[:-1]), [True]])) if len(on) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if on[lo] != number:
                closed()
                if found:
                    yield _facts_of(cell, found, path_type)
                number, parts, cell, pairs, found[:] = on[lo], [], None, 0, []
            part = b.slice(lo, hi - lo)
            if role[lo] == 0:
                parts.append(part.select(KIND))
                continue
            if not parts:
                continue
            if cell is None:
                cell = _Cell(pa.Table.from_batches(parts))
            for p, language, signals, tokens in zip(*(part.column(c).to_pylist() for c in ("path", "language", "signals", "tokens"))):
                if p != path:
                    pairs += closed()
                    if pairs >= PAIRS:
                        yield _facts_of(cell, found, path_type)
                        pairs = 0
                        found.clear()
                    path = p
                if len(hit := cell.hits(p, language, signals, tokens)):
                    at.append(hit)
    closed()
    if found:
        yield _facts_of(cell, found, path_type)


def kinds(specs: DataFrame) -> DataFrame:
    """Specifications as SPECS -> tokens, languages, triggers, path_tokens, members: (enricher, type, tags) of those that are alike in the others; a kind of very many is several rows."""
    names = ["tokens", "languages", "triggers", "path_tokens"]
    none = F.array().cast("array<string>")
    s = specs.where("size(tokens) > 0").select(*names, F.struct(F.col("id").alias("enricher"), "type", F.coalesce("tags", none).alias("tags")).alias("member")).withColumn("like", F.xxhash64(*names))
    # Kinds of one hash have their sizes added up, which only deals them into more rows.
    s = s.join(s.groupBy("like").agg(F.ceil(F.count("*") / MEMBERS).alias("rows")), "like").withColumn("row", F.pmod(F.xxhash64("member"), "rows"))
    return s.groupBy(*names, "row").agg(F.collect_list("member").alias("members")).drop("row")


def facts(files: DataFrame, specs: DataFrame) -> DataFrame:
    """files(path, language, content, signals), specs as SPECS -> path, enricher, type, name, tags, confidence, hint.

    A specification applies to its languages (to all if it has none), where one of its triggers is a signal, or begins one up to a / or a dot,
    or it has none, and where the path holds one of its path_tokens. The first listed of the tokens that the text, without
    comments, holds makes the fact. Files of one path make one fact together.
    """
    alike = stored(kinds(specs))[0]
    texts = held_tokens(files.select("path", "language", "signals", without_comments(F.col("content")).alias("code")), alike.select(F.explode("tokens").alias("token")))
    weight = alike.agg(F.sum(F.size("tokens") + F.size("members") / LIGHT)).first()[0] or 0
    cells = max(1, math.ceil(weight / CELL_TOKENS))
    # Few cells are each held by several tasks, and a text passes by one of them.
    parts = -(-int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")) // cells)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    path_type, member = files.schema["path"].dataType, alike.schema["members"].dataType
    blank = lambda *names: [F.lit(None).cast("array<string>").alias(c) for c in names]
    one = alike.withColumn("part", every(parts)).select(
        (F.pmod(F.xxhash64("members"), F.lit(cells)).cast("int") * parts + F.col("part")).alias("cell"), F.lit(0).alias("role"), F.lit(None).cast(path_type).alias("path"), F.lit(None).cast("string").alias("language"), *blank("signals"), *KIND)
    two = texts.withColumn("at", every(cells)).select(
        (F.col("at") * parts + F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")).alias("cell"), F.lit(1).alias("role"), "path", "language", "signals", "tokens", *blank("languages", "triggers", "path_tokens"), F.lit(None).cast(member).alias("members"))
    met = one.unionByName(two).repartitionById(cells * parts, "cell").sortWithinPartitions("cell", "role", "path")
    told = met.mapInArrow(_met, f"members {member.simpleString()}, held array<struct<path: {path_type.simpleString()}, name: string>>")
    rows = told.select("members", F.explode("held").alias("h")).select(F.col("h.path").alias("path"), F.col("h.name").alias("name"), F.inline("members"))
    return rows.select("path", "enricher", "type", "name", "tags", F.lit(CONFIDENCE).alias("confidence"), F.lit(HINT).alias("hint"))
