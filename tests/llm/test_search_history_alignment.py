"""Nearest vectors, dimension history and token alignment against brute force and odd inputs."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers

from arborlens.llm import alignment, history, nearest, queries

D = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, source string, unit string, pair int, bucket string"


# -- nearest vectors -----------------------------------------------------------


def true_nearest(rows, query_ids, k=10):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], float)
    out = {}
    for q in query_ids:
        d = np.sqrt(((v - v[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        order = np.lexsort((ids, d))
        out[q] = [(int(ids[i]), float(d[i])) for i in order if ids[i] != q][:k]
    return out


def lists_of(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_nearest_vectors_recall_and_exact_scores(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()]
    got = lists_of(queries.op11_nearest_vectors(spark, D))
    due = true_nearest(rows, [i for i, _ in rows if i % 100 == 0])
    assert got.keys() == due.keys() and all(len(x) == 10 for x in got.values())
    hit = sum(len({i for i, _ in due[q]} & {i for i, _ in got[q]}) for q in due)
    assert hit >= 0.9 * 10 * len(due)
    v = dict(rows)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (x[1], x[0])) and q not in dict(found)
        for i, s in found:
            assert abs(s - np.sqrt(((np.array(v[i]) - np.array(v[q])) ** 2).sum())) < 1e-12
    e = spark.read.parquet(f"{D}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    assert nearest.recall(queries.op11_nearest_vectors(spark, D), e, [0, 100, 200]) >= 0.9


def test_nearest_vectors_in_many_cells_and_copied_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((12, 24)) * 3
    rows = [(i, (centre[i % 12] + rng.standard_normal(24) * 0.4).tolist()) for i in range(3000)]
    for name, value in (("BLOCK_ROWS", 150), ("VISITS", 7), ("CELLS", 16), ("SAMPLE", 900), ("LEAF_ROWS", 8)):
        monkeypatch.setattr(nearest, name, value)
    t = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    found = nearest.nearest(t, t.where("id % 20 = 0"), k=10)
    got, due = lists_of(found), true_nearest(rows, range(0, 3000, 20))
    assert got.keys() == due.keys()
    hit = sum(len({i for i, _ in due[q]} & {i for i, _ in got[q]}) for q in due)
    assert hit >= 0.95 * 10 * len(due)
    assert lists_of(nearest.nearest(t.repartition(3), t.where("id % 20 = 0"), k=10)) == got


def test_nearest_vectors_without_the_test_is_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(400)]
    t = spark.createDataFrame(rows, "id long, embedding array<double>")
    found = nearest.nearest(t, t.where("id % 10 = 0"), k=5, confidence=1 - 1e-12, dimensions=4)
    got, due = lists_of(found), true_nearest(rows, range(0, 400, 10), 5)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in due.items()}


def test_chi_square_and_the_share_passed_over():
    assert abs(nearest.chi_square(nearest.stopping_ratio(0.98, 8), 8) - 0.98) < 1e-9
    assert abs(nearest.chi_square(2.0, 2) - (1 - np.exp(-1))) < 1e-12
    # The projected distance of random pairs follows the law that the stopping test relies on.
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 40))
    ratio = ((x @ nearest.directions(40)) ** 2).sum(1) / (x**2).sum(1)
    assert abs((ratio <= nearest.stopping_ratio(0.98, 8)).mean() - 0.98) < 0.03


def test_verified_vectors_are_fewer_than_all():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((4000, 32)) * 0.2 + c for c in rng.standard_normal((8, 32)) * 3])
    p = x @ nearest.directions(32)
    block = nearest.Block(x, p, [np.array([i]) for i in range(len(x))])
    dist, ids, verified = block.nearest(x[7], p[7], float("inf"), 11, nearest.stopping_ratio())
    assert ids[0] == 7 and dist[0] == 0 and len(ids) == 11 and verified < len(x) / 4


def test_nearest_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.0, 2.0]) for i in range(100, 140)]
    rows = [(0, [1.0, 0.0, 2.0]), (0, [1.0, 0.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [1.0, 2.0]), (None, [1.0, 0.0, 2.0]), (200, [5.0, 5.0, 5.0]), (300, [0.0, 0.0, 0.0]), *same]
    t = spark.createDataFrame([(i, v, 1, 2, "p") for i, v in rows], "id long, embedding array<double>, cell int, block int, p string").repartition(4)
    got = lists_of(nearest.nearest(t, t.where("id % 100 = 0"), k=10))
    assert got.keys() == {0, 100, 200}
    assert got[0] == [(i, 0.0) for i in range(100, 110)]
    assert got[100] == [(i, 0.0) for i in (0, *range(101, 110))]
    assert [i for i, _ in got[200]] == [0, *range(100, 109)]
    # All candidates, if fewer than k; none of none.
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-2.0])], "id long, embedding array<double>")
    assert lists_of(nearest.nearest(few, few.where("id = 0"), k=10)) == {0: [(1, 1.0), (2, 3.0)]}
    assert nearest.nearest(t.where("false"), t.where("false")).collect() == []
    assert nearest.nearest(few.where("id = 0"), few.where("id = 0")).collect() == []


# -- dimension history -----------------------------------------------------------


def walked(rows):
    """Day by day, change by change."""
    changes = {}
    for d, source in rows:
        for j in (0, 1):
            h = int(hashlib.sha256(f"{d}:{j}".encode()).hexdigest()[:12], 16)
            kind = "delete" if h // 1000 % 10 < 2 else "correct" if h // 1000 % 10 < 5 else "update"
            changes.setdefault(d - d % 10, []).append((h, d, j, h % 60, kind, source))
    out = []
    for key, own in changes.items():
        own.sort(key=lambda x: x[:3])
        runs = []
        for day in range(0, 72):
            held = [x for x in own if x[4] == "correct" and x[3] <= day < x[3] + 10]
            if held:
                now = [held[-1][5]]
            else:
                base = [(x[3], i) for i, x in enumerate(own) if x[4] != "correct" and x[3] <= day]
                x = own[max(base)[1]] if base else None
                now = [] if x is None or x[4] == "delete" else [x[5]]
            if now and runs and runs[-1][1] == day and runs[-1][2] == now[0]:
                runs[-1][1] = day + 1
            elif now:
                runs.append([day, day + 1, now[0]])
        out += [(key, i + 1, a, None if b == 72 else b, v) for i, (a, b, v) in enumerate(runs)]
    return sorted(out, key=lambda x: x[:2])


def test_history_against_a_walk_and_sql(spark):
    rows = [(r["doc_id"], r["source"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op12_dimension_history(spark, D).collect()))
    assert got == walked(rows)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
        assert sorted(con.execute(queries.ORACLE_SQL["op12_dimension_history"]).fetchall()) == got


def test_history_nulls_and_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(d, rng.choice(["a", "b", None])) for d in range(57)]
    t = spark.createDataFrame([(*r, "x", 0) for r in [*rows, *rows[:30], *[(11, rows[11][1])] * 500, (None, "a")]], "doc_id long, source string, value string, key int").repartition(4)
    assert sorted((tuple(r) for r in history.versions(history.document_changes(t), shard_changes=20).collect()), key=lambda x: x[:2]) == walked(rows)
    assert history.versions(history.document_changes(t.where("false"))).collect() == []


def test_history_of_changes_of_any_length(spark):
    # (key, kind, from, to, arrival, value): a correction over a deletion, one that outlasts another, equal neighbours, a null value.
    rows = [(1, 0, 0, None, 1, "a"), (1, 1, 10, None, 2, "x"), (1, 2, 5, 12, 3, "a"), (1, 2, 11, 20, 4, None), (1, 2, 30, 30, 5, "none"), (1, 0, 40, None, 6, None), (2, 1, 0, None, 1, None), (3, 2, 2, 4, 1, "c"), (3, 2, 2, 4, 9, "d"), (None, 0, 1, None, 1, "z"), (4, 0, None, None, 1, "z")]
    t = spark.createDataFrame(rows, "key long, kind int, valid_from long, valid_to long, arrival long, value string")
    assert sorted((tuple(r) for r in history.versions(t).collect()), key=lambda x: x[:2]) == [(1, 1, 0, 11, "a"), (1, 2, 11, 20, None), (1, 3, 40, None, None), (3, 1, 2, 4, "d")]


def test_a_hot_key_is_reduced_before_it_is_dealt(spark):
    t = spark.range(20_000).selectExpr("1L AS key", "cast(id % 5 as int) % 3 AS kind", "id % 60 AS valid_from", "id % 60 + 10 AS valid_to", "id AS arrival", "concat('v', id % 7) AS value")
    assert history.last_arrived(t).count() <= 120


# -- token alignment ---------------------------------------------------------------


def whole_text(texts):
    """Every text encoded as a whole, groups by walking both lists of tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    byte = alignment._byte_level()
    name = {i: s for s, i in t.get_vocab().items()}
    a_bytes = lambda i: bytes(byte[c] for c in name[i]) if all(c in byte for c in name[i]) else name[i].encode()
    b_bytes = lambda i: bytes([i - 3]) if 3 <= i < 259 else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], {}
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            a, b = [], []
        groups, i, j, x, y, now_a, now_b = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                x += len(a_bytes(a[i]))
                now_a.append(a[i])
                i += 1
            else:
                y += len(b_bytes(b[j]))
                now_b.append(b[j])
                j += 1
            if x == y and now_a and now_b:
                groups.append((now_a, now_b))
                now_a, now_b = [], []
        docs.append((a, b, groups))
        for pair in {(p, q) for g, h in groups for p in g for q in h}:
            counts[pair] = counts.get(pair, 0) + 1
    most = {}
    for (p, _), n in counts.items():
        most[p] = max(most.get(p, 0), n)
    out = []
    for a, b, groups in docs:
        links = [(p, q) for g, h in groups for p in g for q in h]
        sha = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), sha))
    return out


def odd_texts():
    rng = random.Random(8)
    bits = ["foo", "Bar,", "baz.", " ", "  ", "   ", "\n", "\t", "\r\n", "é", "ü,", " ", "　", " ", "\x1c", "\x85", "n't", "'s", "’s", "x²,", "é,", "你好", "。", "🙂", "👩‍👩‍👧", "<|endoftext|>", "</s>", "<unk>", "_a_", "--", "...", "123,", "4.5", "ﬁ", "Ⅷ.", "​", "\u0000", "ا،", "न्,", "▁"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    return [None, "", " ", "  lead", "tail ", "a\n b", "a \nb", "one", "one", *made, "word, " * 30_000 + "end"]


def test_alignment_of_stretches_equals_that_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "UNIT_BYTES", 3000)
    texts = odd_texts()
    t = spark.createDataFrame([(i, x, None, "u", 1, "b") for i, x in enumerate(texts)], DOCS).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in alignment.aligned(t, A, B).collect()}
    due = whole_text(texts)
    for i, x in enumerate(due):
        assert got[i][:4] + got[i][6:] == x[:4] + x[6:] and got[i] == x, repr(texts[i])[:200]
    assert got[0] == got[1] == (0, 0, 0, 0, 0, 0, "")
    # Texts with U+2581 do not come back from B's pieces.
    assert all(got[i][0] == 0 for i, x in enumerate(texts) if x and "▁" in x)


def test_alignment_of_the_documents(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = {r[0]: tuple(r)[1:] for r in queries.op13_token_alignment(spark, D).collect()}
    assert got == dict(zip(rows, whole_text(rows.values())))


def test_alignment_forgets_and_learns_again(spark, monkeypatch):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(40)
    due = sorted(map(tuple, alignment.aligned(docs, A, B).collect()))
    monkeypatch.setattr(alignment, "KEPT_STRETCHES", 50)
    monkeypatch.setattr(alignment, "UNIT_BYTES", 20_000)
    assert sorted(map(tuple, alignment.aligned(docs, A, B).collect())) == due


def test_spans_cover_the_bytes(spark):
    t = spark.createDataFrame([(1, "Grüße, world  x", None, "u", 1, "b"), (2, None, None, "u", 1, "b"), (3, "▁", None, "u", 1, "b")], DOCS)
    got = sorted(map(tuple, alignment.spans(t, A, B).collect()))
    assert {r[0] for r in got} == {1} and got[0][1] == 0 and got[-1][2] == len(" Grüße, world  x".encode())
    assert all(x[2] == y[1] for x, y in zip(got, got[1:])) and all(r[3] and r[4] for r in got)
    told = alignment.aligned(t, A, B).where("doc_id = 1").first()
    assert hashlib.sha256(";".join(",".join(map(str, r[3])) + "|" + ",".join(map(str, r[4])) for r in got).encode()).hexdigest() == told["groups_sha256"]


def test_alignment_of_odd_tables(spark):
    t = spark.createDataFrame([(None, "a b", None, "u", 1, "b"), (1, "a b", None, "u", 1, "b"), (1, "a b", None, "u", 1, "b")], DOCS)
    got = sorted(map(tuple, alignment.aligned(t, A, B).collect()), key=str)
    assert len(got) == 3 and all(r[1:] == got[0][1:] and r[6] == 3 * r[4] for r in got)
    assert alignment.aligned(t.where("false"), A, B).collect() == []
    assert alignment.spans(t.where("false"), A, B).collect() == []
