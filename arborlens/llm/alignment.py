"""Alignment of two tokenizers' tokens: DuckDB on interval tables, partial pair counts merged in Spark.

Tokenizer A is a byte-level BPE file of the tokenizers library, which gets a
space and the text; B is a sentencepiece model, which adds that space itself.
Tokens are byte intervals of the same bytes. Bytes at which an A and a B token both
end cut them into groups; every A and every B token of a group are linked. A
pair of ids counts as often as documents of the whole corpus hold it linked.

Both tokenizers break before a single space between two visible characters (A's pattern
starts a piece there, and no piece of B holds a space behind another character), and so they do
between a letter and a mark that no piece of B holds behind one. Each stretch of text between such
places has the same tokens and groups wherever it stands. A task gathers UNIT_BYTES of text, and
its new stretches go through DuckDB as interval tables: an ASOF join finds the
common ends, a window sum numbers the groups, an ASOF join over the groups' ranges deals B's
tokens to them, and a join within groups makes the links. Results are kept for stretches to come, up to a bound. A document's
stretches, joined with their links, give the unit's pairs and in how many of its documents each is linked.

Units are written to the shared folder: a row for each document (its stretches and how often each stands in it) and
a row of the unit's pairs. Spark sums the units' counts, finds the highest count of each
A id, joins both to the units' pairs, and adds them up by document within each
unit. What is shuffled is a row for each different pair of a unit, not one for each link.

Defined results: a null or empty text, and a text whose A or B tokens do not
join to its bytes, has no tokens: zeros and an empty text for the hash. Repeated rows
count as documents of their own. Null ids are kept. Very long texts are one unit. An empty table gives no
rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import lists, prepare, stored

#: Bytes of text that a task gathers before DuckDB counts its pairs.
UNIT_BYTES = 4 << 20
#: Parts between spaces, and bytes of stretches, that a worker keeps.
KEPT_STRETCHES, KEPT_BYTES = 500_000, 24 << 20
#: Texts that the tokenizers get at once, and stretches joined to one text.
ENCODED, RUN = 4096, 128
#: Stretches that go through DuckDB at once.
LEARNED = 40_000
DUCKDB = {"threads": 1, "memory_limit": "300MB"}
_CUT = re.compile(r"(?<=\S)(?= \S)")
_MARK = re.compile(r"(.*[^\W\d_])([^\w\s].*)", re.S)
#: Stands before a stretch that does not start with a space when B, which adds one, gets it.
_LETTER = "a"

UNIT_SCHEMA = (
    "unit long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "stretch array<int>, times array<int>, "  # of a document
    "pair array<long>, documents array<int>, first array<int>, linked array<int>, links array<int>"  # of the unit
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SPANS = "doc_id long, start long, end long, a array<int>, b array<int>"

#: Interval tables a, b (stretch, s, e, id; s and e on one axis of bytes) to groups with their range.
GROUPS_SQL = """
CREATE TEMP TABLE marked AS
SELECT stretch, s, e, id,
       coalesce(sum(hit) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS grp
FROM (SELECT a.stretch, a.s, a.e, a.id, (b.e = a.e)::INTEGER AS hit FROM a ASOF LEFT JOIN b ON a.e >= b.e);
CREATE TEMP TABLE grouped AS SELECT grp, min(stretch) AS stretch, min(s) AS s, max(e) AS e FROM marked GROUP BY grp;
CREATE TEMP TABLE dealt AS
SELECT g.grp, g.stretch, b.s, b.id FROM b ASOF JOIN grouped g ON b.s >= g.s;
"""
LINKS_SQL = """
SELECT m.stretch, (m.id::BIGINT << 32) + d.id AS pair, count(*)::INTEGER AS links
FROM marked m JOIN dealt d USING (grp) GROUP BY ALL ORDER BY 1, 2
"""
#: All tokens, group by group, A's before B's.
ORDERED_SQL = """
SELECT grp, stretch, side, id FROM (
  SELECT grp, stretch, 0 AS side, s, id FROM marked UNION ALL SELECT grp, stretch, 1, s, id FROM dealt)
ORDER BY grp, side, s
"""
SPANS_SQL = """
WITH x AS (SELECT grp, list(id ORDER BY s) AS a FROM marked GROUP BY grp),
     y AS (SELECT grp, list(id ORDER BY s) AS b FROM dealt GROUP BY grp)
SELECT g.stretch, g.s, g.e, a, b FROM grouped g JOIN x USING (grp) JOIN y USING (grp) ORDER BY grp
"""
#: held(doc, stretch), linked(stretch, pair): in how many documents each pair is linked.
COUNT_SQL = """
SELECT pair, count(*)::INTEGER AS documents
FROM (SELECT DISTINCT doc, pair FROM held JOIN linked USING (stretch)) GROUP BY pair ORDER BY pair
"""


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Stretches of text to tokens, groups and links. Each Python worker has its own, and keeps what it has aligned."""

    _made: dict[tuple[str, str], Aligner] = {}

    @classmethod
    def get(cls, a_path: str, b_path: str) -> Aligner:
        if (a_path, b_path) not in cls._made:
            cls._made[a_path, b_path] = cls(a_path, b_path)
        return cls._made[a_path, b_path]

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_level()
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for t, i in entries.items():
            self.a_bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_length, self.b_length = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        text = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.joined = {y for p in text for x, y in zip(p, p[1:]) if x.isalnum() and not y.isalnum()}
        self.forget()

    def forget(self) -> None:
        #: Parts between spaces to their row in halves, and stretches to their number.
        self.parts: dict[str, int] = {}
        self.halves = np.zeros((0, 2), np.int64)
        self.place: dict[str, int] = {}
        self.bytes = 0
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(0, np.int64) for _ in range(4))
        self.good = np.zeros(0, bool)
        self.text: list[str] = []
        self.first, self.pair, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def runs(self, stretches: list[str]) -> list[str]:
        """Stretches joined to texts of RUN of them: each starts with a space behind a visible character, so tokens do not cross."""
        return ["".join(stretches[at : at + RUN]) for at in range(0, len(stretches), RUN)]

    def tokens(self, stretches: list[str], joined: bool) -> tuple[list, list]:
        """A's ids and B's ids, one list for each stretch, or for each run of them."""
        texts = self.runs(stretches) if joined else stretches
        a, b = [], []
        for at in range(0, len(texts), ENCODED):
            part = texts[at : at + ENCODED]
            a += [x.ids for x in self.a.encode_batch_fast(part, add_special_tokens=False)]
            b += [x if y[0] == " " else x[1:] for x, y in zip(self.b.encode([x[1:] if x[0] == " " else _LETTER + x for x in part], num_threads=1), part)]
        return a, b

    def token_table(self, ids: list, entry: list[bytes], length: np.ndarray, raw: list[bytes], end: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, ends on the axis of all stretches' bytes, stretches that do not join to their bytes); None if runs have to be taken apart."""
        if joined:
            flat = np.fromiter(chain.from_iterable(ids), np.int32)
            at = np.cumsum(length[flat])
            whole = len(at) and at[-1] == end[-1] and np.isin(end, at).all() and b"".join(map(entry.__getitem__, flat.tolist())) == b"".join(raw)
            return (flat, at, np.zeros(0, np.int64)) if whole else None
        bad = np.array([k for k, (x, y) in enumerate(zip(ids, raw)) if b"".join(map(entry.__getitem__, x)) != y], np.int64)
        return np.zeros(0, np.int32), np.zeros(0, np.int64), bad

    def intervals(self, con, stretches: list[str], in_runs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Register the interval tables a and b of the stretches whose tokens join to them; (A's and B's number of tokens, good)."""
        raw = [s.encode() for s in stretches]
        end = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        lengths, entries, good, tables = (self.a_length, self.b_length), (self.a_bytes, self.b_bytes), np.ones(len(raw), bool), [None, None]
        # Runs of stretches that start with a space and end visibly, unless one of them does not come back.
        if in_runs:
            tables = [self.token_table(ids, entry, length, raw, end, True) for ids, entry, length in zip(self.tokens(stretches, True), entries, lengths)]
        if None in tables:
            both, tables = self.tokens(stretches, False), []
            for ids, entry, length in zip(both, entries, lengths):
                good[self.token_table(ids, entry, length, raw, end, False)[2]] = False
            for ids, length in zip(both, lengths):
                ids = [x if ok else [] for x, ok in zip(ids, good)]
                n, flat = np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.int32)
                size = np.cumsum(length[flat])
                # Ends within the stretch, moved to where it starts.
                first = np.concatenate([[0], size])[np.concatenate([[0], np.cumsum(n)])[:-1]]
                tables.append((flat, size + np.repeat(np.concatenate([[0], end])[:-1] - first, n), None))
        counts = []
        for name, (flat, at, _), length in zip(("a", "b"), tables, lengths):
            stretch = np.searchsorted(end, at - 1, "right").astype(np.int32)
            con.register(name, pa.table({"stretch": stretch, "s": at - length[flat], "e": at, "id": flat}))
            counts.append(np.bincount(stretch, minlength=len(raw)))
        con.execute(GROUPS_SQL)
        return counts[0], counts[1], good

    def learn(self, stretches: list[str], in_runs: bool) -> None:
        """Align stretches that are not yet kept, and keep what comes of it."""
        import duckdb

        with duckdb.connect(config=DUCKDB) as con:
            n_a, n_b, good = self.intervals(con, stretches, in_runs)
            links = con.sql(LINKS_SQL).to_arrow_table()
            tokens = con.sql(ORDERED_SQL).to_arrow_table()
        n, stretch, times = len(stretches), links["stretch"].to_numpy(), links["links"].to_numpy()
        shown, groups = shown_groups(tokens, n)
        for name, more in (("n_a", n_a), ("n_b", n_b), ("n_groups", groups), ("n_links", np.bincount(stretch, times, n).astype(np.int64)), ("good", good)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(stretch, minlength=n))])
        self.pair = np.concatenate([self.pair, links["pair"].to_numpy()])
        self.links = np.concatenate([self.links, times])
        self.text += shown
        for s in stretches:
            self.place[s] = len(self.place)
        self.bytes += sum(map(len, stretches))

    def cut(self, key: str) -> tuple[str, ...]:
        """The stretches of a regular part (in two where a letter meets a mark that B joins to none), or of what starts with a space: itself."""
        if key.startswith(" "):
            return (key,)
        found = _MARK.fullmatch(key)
        return (" " + key,) if not found or found[2][0] in self.joined else (" " + found[1], found[2])

    def unit(self, number: int, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        """The rows of one unit: its documents and its pairs."""
        import duckdb

        if len(self.parts) > KEPT_STRETCHES or self.bytes > KEPT_BYTES:
            self.forget()
        cut = [t.split(" ") if t else [] for t in texts]
        fresh = set(chain.from_iterable(cut)).difference(self.parts)
        if odd := {k for k in fresh if not is_regular(k)}:
            # A part between two spaces starts with none, so what starts with one is no part.
            cut = [keys if odd.isdisjoint(keys) else _CUT.split(" " + t) for keys, t in zip(cut, texts)]
            fresh = set(chain.from_iterable(cut)).difference(self.parts)
        new = {k: self.cut(k) for k in sorted(fresh)}
        # Regular stretches go in runs; marks and what starts with a space by themselves.
        heads = dict.fromkeys(x[0] for k, x in new.items() if k[0] != " ")
        others = dict.fromkeys(x[-1] for k, x in new.items() if k[0] == " " or len(x) > 1)
        for kind, in_runs in ((heads, True), (others, False)):
            some = [s for s in kind if s not in self.place]
            for at in range(0, len(some), LEARNED):
                self.learn(some[at : at + LEARNED], in_runs)
        if new:
            self.parts.update(zip(new, range(len(self.parts), len(self.parts) + len(new))))
            self.halves = np.concatenate([self.halves, np.array([(self.place[x[0]], self.place[x[1]] if len(x) > 1 else -1) for x in new.values()])])
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = self.halves[np.fromiter(map(self.parts.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))].ravel()
        doc = np.repeat(np.arange(len(cut)), 2 * n)[flat >= 0]
        flat = flat[flat >= 0]
        # A document with a stretch that does not come back has no tokens.
        good = (n > 0) & (np.bincount(doc, ~self.good[flat], len(cut)) == 0)
        flat, doc = flat[good[doc]], doc[good[doc]]
        end = np.cumsum(np.bincount(doc, minlength=len(cut)))
        # Stretches of the unit, numbered from 0.
        used, local = np.unique(flat, return_inverse=True)
        both, times = np.unique(doc * (len(used) + 1) + local, return_counts=True)
        held_doc, held = both // (len(used) + 1), both % (len(used) + 1)
        size = (self.first[1:] - self.first[:-1])[used]
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.first[:-1][used] - start[:-1], size) + np.arange(start[-1])
        pair, links = self.pair[at], self.links[at]
        with duckdb.connect(config=DUCKDB) as con:
            con.register("held", pa.table({"doc": held_doc.astype(np.int32), "stretch": held.astype(np.int32)}))
            con.register("linked", pa.table({"stretch": np.repeat(np.arange(len(used), dtype=np.int32), size), "pair": pair}))
            counts = con.sql(COUNT_SQL).to_arrow_table()
        names = counts["pair"].to_numpy()
        sums = {c: np.bincount(doc, getattr(self, c)[flat], len(cut)).astype(np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        order, text = flat.tolist(), self.text.__getitem__
        shas = [hashlib.sha256(";".join(map(text, order[a:b])).encode()).hexdigest() if ok else "" for a, b, ok in zip([0, *end.tolist()], end.tolist(), good.tolist())]
        per_doc = np.bincount(held_doc, minlength=len(cut))
        none = np.zeros(len(cut), np.int64)
        empty = np.zeros(0, np.int32)
        yield pa.record_batch({
            "unit": pa.array(np.full(len(cut), number)), "doc_id": pa.array(ids, pa.int64()), **{c: pa.array(v) for c, v in sums.items()},
            "groups_sha256": pa.array(shas, pa.string()), "stretch": lists(held.astype(np.int32), per_doc), "times": lists(times.astype(np.int32), per_doc),
            "pair": lists(np.zeros(0, np.int64), none), "documents": lists(empty, none), "first": lists(empty, none), "linked": lists(empty, none), "links": lists(empty, none),
        })
        zero = pa.array([0], pa.int64())
        yield pa.record_batch({
            "unit": pa.array([number], pa.int64()), "doc_id": pa.array([None], pa.int64()), **{c: zero for c in sums},
            "groups_sha256": pa.array([None], pa.string()), "stretch": lists(empty, [0]), "times": lists(empty, [0]),
            "pair": lists(names, [len(names)]), "documents": lists(counts["documents"].to_numpy(), [len(names)]), "first": lists(start.astype(np.int32), [len(start)]),
            "linked": lists(np.searchsorted(names, pair).astype(np.int32), [len(pair)]), "links": lists(links, [len(links)]),
        })


def is_regular(part: str) -> bool:
    """Whether what stands between two spaces is a stretch: visible at both ends."""
    return bool(part) and not part[0].isspace() and not part[-1].isspace()


def shown_groups(tokens: pa.Table, n: int) -> tuple[list[str], np.ndarray]:
    """Ordered tokens of n stretches -> (each one's groups as text, their number)."""
    grp, stretch, side, ids = (tokens[c].to_numpy() for c in ("grp", "stretch", "side", "id"))
    if not len(ids):
        return [""] * n, np.zeros(n, np.int64)
    opened = np.ones(len(ids), bool)
    opened[1:] = grp[1:] != grp[:-1]
    kind = np.zeros(len(ids), np.int64)
    kind[1:] = np.where(opened[1:], np.where(stretch[1:] != stretch[:-1], 3, 2), side[1:] != side[:-1])
    text = "".join(chain.from_iterable(zip(np.array(list(",|;/"), object)[kind].tolist(), map(str, ids.tolist()))))[1:].split("/")
    shown = [""] * n
    for k, t in zip(stretch[np.concatenate([[0], np.flatnonzero(kind == 3)])].tolist(), text):
        shown[k] = t
    return shown, np.bincount(stretch[opened], minlength=n).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """(number, ids, texts) of units of about UNIT_BYTES; the number holds the partition's."""
    part, k = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if texts and size + len(t or "") > UNIT_BYTES:
                yield (part << 32) + k, ids, texts
                ids, texts, size, k = [], [], 0, k + 1
            ids.append(i)
            texts.append(t)
            size += len(t or "")
    if texts:
        yield (part << 32) + k, ids, texts


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def units(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document with its stretches, and one for each unit with its pairs (groups_sha256 null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.get(a_path, b_path)
        for number, ids, texts in _gathered(batches):
            yield from aligner.unit(number, ids, texts)

    prepare(docs.sparkSession)
    return _ids_and_texts(docs).mapInArrow(run, UNIT_SCHEMA)


def unit_pairs(rows: DataFrame) -> DataFrame:
    """units() to (unit, place, pair, documents): a unit's different pairs, numbered from 0."""
    own = rows.where("groups_sha256 IS NULL").select("unit", F.posexplode(F.arrays_zip("pair", "documents")).alias("place", "p"))
    return own.select("unit", "place", F.col("p.pair").alias("pair"), F.col("p.documents").alias("documents"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """units() to (a, b, documents, best): in how many documents a pair is linked, and whether no pair of its A id is in more."""
    counts = unit_pairs(rows).groupBy("pair").agg(F.sum("documents").alias("documents")).select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "documents")
    # An A id has as many pairs as B has ids at most.
    return counts.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))


def _summed(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """One unit: counts of its pairs, in order of their places, added up by document."""
    own = rows.filter(pa.compute.is_null(rows["groups_sha256"]))
    docs = rows.filter(pa.compute.is_valid(rows["groups_sha256"]))
    place = counts["place"].to_numpy()
    n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    n[place], best[place] = counts["documents"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
    first, linked, links = (np.asarray(own[c].combine_chunks().values) for c in ("first", "linked", "links"))

    def by_stretch(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[linked] * links)]).astype(np.int64)
        return total[first[1:]] - total[first[:-1]]

    stretch = docs["stretch"].combine_chunks()
    of, times = np.asarray(stretch.flatten()), np.asarray(docs["times"].combine_chunks().flatten()).astype(np.int64)
    end = np.cumsum(np.asarray(pa.compute.list_value_length(stretch)))
    out = {}
    for name, values in (("n_best", best), ("count_sum", n)):
        total = np.concatenate([[0], np.cumsum(by_stretch(values)[of] * times)]).astype(np.int64)
        out[name] = total[end] - total[np.concatenate([[0], end[:-1]])]
    return pa.table({**{c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, **out, "groups_sha256": docs["groups_sha256"]})


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs(doc_id, text) -> a row for each document: numbers of tokens, groups and links, links whose pair is its A id's commonest, sum of the links' counts, hash of the groups."""
    rows = stored(units(docs, a_path, b_path), "alignment_units")
    counts = pair_counts(rows).select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "documents", "best")
    told = unit_pairs(rows).select(F.col("unit").alias("of_unit"), "place", "pair").join(counts, "pair").select("of_unit", "place", "documents", "best")
    return rows.groupBy("unit").cogroup(told.groupBy("of_unit")).applyInArrow(_summed, ALIGNED)


def spans(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs(doc_id, text) -> a row for each group: its range of bytes in a space and the text, and A's and B's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        aligner = Aligner.get(a_path, b_path)
        for _, ids, texts in _gathered(batches):
            whole = [" " + t for t in texts if t]
            ids = pa.array([i for i, t in zip(ids, texts) if t], pa.int64())
            base = np.cumsum([0, *(len(t.encode()) for t in whole)])
            with duckdb.connect(config=DUCKDB) as con:
                aligner.intervals(con, whole, False)
                found = con.sql(SPANS_SQL).to_arrow_table()
            at = found["stretch"].to_numpy()
            out = pa.table({"doc_id": ids.take(pa.array(at)), "start": found["s"].to_numpy() - base[at], "end": found["e"].to_numpy() - base[at], "a": found["a"].cast(pa.list_(pa.int32())), "b": found["b"].cast(pa.list_(pa.int32()))})
            yield from out.to_batches(max_chunksize=100_000)

    prepare(docs.sparkSession)
    return _ids_and_texts(docs).mapInArrow(run, SPANS)
