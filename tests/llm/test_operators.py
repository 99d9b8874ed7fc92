"""Training-data operators against brute force, round trips, held-out accuracy and odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from arborlens.llm import core, decontam, fingerprint, lm_scores, mixing, near_dedup, quality, queries, sharding, similarity, substring_dedup, suffix_dedup, tokens

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item string, k1 int, bucket string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, repeated rows, equal ids, clashing extra columns."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, long_ = say(120), say(8000)
    near = base.split()
    near[50] = "changed"
    part = say(70) + "."
    rows = [(1, base, "en", "b"), (2, " ".join(near), "en", "b"), (3, base, "de", "a"), (3, base, "de", "a"), (4, None, "en", "a"), (5, "", None, None), (6, " \n\t ", "fr", None),
            (7, long_, "en", "c"), (None, say(30), "en", "b"), (9, "one", "en", "c"), (10, "One", "en", "c"), (11, say(40) + "\n" + part + "\n" + say(40), "en", "é"), (12, say(35) + "\n" + part + "\n" + say(30), "en", "é"), (13, "aaaa" * 200, "en", "z"), (14, "héé  ü\u2003x 's 's\n\n  tail ", "en", "z")]
    return [(*r, len(r[1] or ""), "x", 1, "y") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def test_mix(odd, docs, none):
    got = mixing.mixed_sizes(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in mixing.mixed_sizes(docs).collect())
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
        assert all(r["taken"] <= 3 * r["size"] and mine[0]["target"] <= 3 * r["source_size"] + 1e-6 for r in mine)
    assert math.isclose(sum({r["source"]: r["target"] for r in got}.values()), sum(r["size"] for r in got))
    few = mixing.mixed_sizes(odd, chunk=2).collect()
    assert len(few) == len(odd_rows()) and all(r["size"] == len(words(t)) for r in few for t in [dict((x[0], x[1]) for x in odd_rows()).get(r["doc_id"])] if r["doc_id"] not in (None,))
    assert mixing.apply_mix(odd).columns == odd.columns
    assert mixing.mixed_sizes(none).count() == 0


@pytest.mark.parametrize("fractions", [[0.3, 0.6, 0.5, 0.2, 0.7, 0.4], [0.35] * 6])
def test_pivot_keeps_mass_and_expectation(fractions):
    sizes, total = [9, 7, 5, 3, 2, 1], np.zeros(6)
    for k in range(4000):
        taken, left = mixing.pivot(sizes, fractions, random.Random(k))
        x = np.where(taken < 0, left, taken)
        assert math.isclose(float(x @ sizes), float(np.dot(sizes, fractions)), abs_tol=1e-6)
        total += x
    assert np.abs(total / 4000 - fractions).max() < 0.04


def spans_by_hand(texts, length):
    seen = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover]) if b else b""
        out.append((len(b), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot,limit", [(512, 8 << 20), (2, 8 << 20), (512, 300), (2, 300)])
def test_suffix_dedup(odd, none, hot, limit):
    rows = [(r[0], (r[1] or "").encode()) for r in odd_rows()]
    want = sorted((str(k), *v) for (k, _), v in zip(rows, spans_by_hand([b for _, b in rows], 200)))
    got = suffix_dedup.remove_repeats(odd, hot=hot, limit=limit).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot,limit", [(512, 8 << 20), (512, 300), (2, 300)])
def test_suffix_dedup_of_equal_lines_in_another_order(spark, hot, limit):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    made = []
    for i in range(12):
        r, a, b = say(60), say(61), say(61)
        made += [(2 * i, r + a + r + b + r), (2 * i + 1, r + b + r + a + r)]
    passage = say(260)
    made += [(100 + i, say(rng.randint(0, 150)) + passage + say(rng.randint(0, 150))) for i in range(9)]
    want = [(k, *v) for (k, _), v in zip(made, spans_by_hand([t.encode() for _, t in made], 200))]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(made, "doc_id long, text string").repartition(3), hot=hot, limit=limit).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert all(w[2] == 0 if w[0] < 100 else 260 <= w[2] < 270 for w in want)


def test_repeated_windows_by_hand():
    rng = random.Random(1)
    members = [bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 60))) for _ in range(30)]
    seen = collections.Counter(m[i : i + 8] for m in members for i in range(len(m) - 7))
    for m, got in zip(members, suffix_dedup.repeated_windows(members, 8)):
        assert got.tolist() == [seen[m[i : i + 8]] > 1 for i in range(len(m) - 7)]


def test_shards(odd, none):
    got = sharding.shard(odd, shards=4).collect()
    assert len(got) == len(odd_rows())
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    for r in got:
        if r["doc_id"] == 5:
            assert (r["size"], r["text_crc32"]) == (8, 0)
    assert sharding.shard(none).count() == 0


def test_hilbert_curve_moves_one_step():
    digits, states = sharding.curve_table(3)
    def index(c, bits=2):
        s = i = 0
        for level in reversed(range(bits)):
            at = s * 8 + sum(((x >> level) & 1) << j for j, x in enumerate(c))
            i, s = i * 8 + digits[at], states[at]
        return i
    cells = sorted(((a, b, c) for a in range(4) for b in range(4) for c in range(4)), key=index)
    assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for p, q in zip(cells, cells[1:]))


def test_token_files(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    segments, dictionary = tokens.write_tokens(odd, path)
    got = tokens.read_tokens(segments, dictionary).collect()
    want = collections.Counter()
    for r in odd_rows():
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    one = [tokens.read_document(bytes(s["body"]), dictionary, 9) for s in segments.collect()]
    assert [x.tolist() for x in one if x is not None] == [t.encode("one", add_special_tokens=False).ids + [2]]
    with pytest.raises(ValueError):
        tokens.opened(bytes(segments.first()["body"]), b"another")
    segments, dictionary = tokens.write_tokens(none, path)
    assert tokens.read_tokens(segments, dictionary).count() == 0


def test_decontamination(spark, docs, odd):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    exact = {(r["doc_id"], b["item_id"]) for r in docs.collect() for b in bench.collect() if b["text"] in r["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert exact <= got and len(got - exact) <= 1
    item = bench.first()["text"].split()
    changed = " ".join(w if i % 9 else "other" for i, w in enumerate(item))
    extra = odd.union(spark.createDataFrame([(99, "before it " + changed + " and after", "en", "q", 1, "x", 1, "y")], SCHEMA))
    left = decontam.decontaminated(extra, bench)
    assert left.columns == extra.columns and {r["doc_id"] for r in extra.collect()} - {r["doc_id"] for r in left.collect()} == {99}
    empty = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert decontam.leaks(odd, empty).count() == 0


def test_decontamination_by_a_large_benchmark(spark, docs):
    rng = random.Random(1)
    hosts = [w for w in (r["text"].split() for r in docs.collect()) if len(w) > 200]
    pool = [w for h in hosts for w in h]
    items = [(k, " ".join(rng.sample(pool, rng.randint(15, 59)))) for k in range(1000)]
    made = []
    for k, text in items:
        host, w, at = rng.choice(hosts), text.split(), rng.randrange(150)
        for i in rng.sample(range(len(w)), len(w) // 5 if k % 2 else 0):
            w[i] = rng.choice(pool)
        made.append((k, " ".join([*host[:at], *w, *host[at:200]])))
    planted = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    got = decontam.leaks(planted, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {k for k, _ in items} == {r["doc_id"] for r in got if r["doc_id"] == r["item_id"]}


def test_decontamination_of_a_long_item(spark, docs):
    rng = random.Random(2)
    item = ["w%d" % rng.randrange(5000) for _ in range(600)]
    told = " ".join(w if i % 10 < 7 else "x%d" % rng.randrange(5000) for i, w in enumerate(item))
    planted = spark.createDataFrame([(1, told), (2, docs.first()["text"])], "doc_id long, text string")
    got = decontam.leaks(planted, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 5)]


def test_longest_common_by_hand():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.longest_common(decontam._masks(np.array(a)), len(a), b) == table[-1][-1]


def test_backoff_scores(odd, none, monkeypatch):
    monkeypatch.setattr(lm_scores, "GROUP_BYTES", 1 << 10)
    rows = [(r[0], words(r[1])) for r in odd_rows()]
    pairs, firsts, single = collections.Counter(), collections.Counter(), collections.Counter()
    for _, w in rows:
        single.update(w), pairs.update(zip([None, *w], w)), firsts.update([None, *w][: len(w)])
    total, want = sum(single.values()), []
    for k, w in rows:
        own, own_first, s = collections.Counter(zip([None, *w], w)), collections.Counter([None, *w][: len(w)]), 0.0
        for p in zip([None, *w], w):
            n = pairs[p] - own[p]
            s += math.log(n / (firsts[p[0]] - own_first[p[0]])) if n else math.log(0.4 * single[p[1]] / total)
        want.append((str(k), len(w), round(s, 4)))
    assert sorted((str(r["doc_id"]), r["n_words"], round(r["log_score"], 4)) for r in lm_scores.backoff_scores(odd).collect()) == sorted(want)
    assert lm_scores.backoff_scores(none).count() == 0


def test_backoff_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op6_backoff_scores"]).fetchall())
    assert sorted((r["doc_id"], r["n_words"], r["log_score"], r["mean_log_score"]) for r in queries.op6_backoff_scores(spark, D).collect()) == want


def test_fingerprints(odd, docs, none):
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    for i, r in enumerate(rows):
        after = rows[(i + 1) % len(rows)]["text"]
        t = r["text"]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[r["doc_id"]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[r["doc_id"]]["edited_fingerprint"] == fingerprint.sums([edited])[0].tobytes().hex()
    assert fingerprint.fingerprints(odd).count() == len(odd_rows()) and fingerprint.fingerprints(none).count() == 0
    a, b, c = (fingerprint.sums([x]) for x in ("p one\nq two", "q two\np one", "q two"))
    assert (a == b).all() and fingerprint.likeness(a, b)[0] == 1
    assert (fingerprint.combined(a, c, -1) == fingerprint.sums(["p one"])).all()
    assert (fingerprint.combined(fingerprint.sums(["p one"]), c) == a).all()


def test_quality(spark, odd):
    d = "/root/testdata/sf0.01"
    texts, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(texts, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(texts, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = [(got[r["doc_id"]] >= 0.5) == (r["quality"] == 1) for r in held]
    assert sum(right) / len(right) > 0.95
    scores = [r["score"] for r in quality.scored(odd, model).collect()]
    assert len(scores) == len(odd_rows()) and all(0 <= s <= 1 for s in scores)
    assert {r["score"] for r in quality.scored(odd, quality.train(texts, labels.limit(0))).collect()} == {0.5}


def by_hand(rows, size):
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()
    root = {k: k for k in sets}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("limit", [similarity.NODE_LIMIT, 2])
def test_near_duplicates(docs, odd, none, monkeypatch, limit):
    if limit == 2:
        monkeypatch.setattr(similarity.node_members, "__defaults__", (2, 2))
    want = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], 2)
    got = near_dedup.near_duplicates(docs, shingle=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    if limit == 2:
        return
    few = near_dedup.near_duplicates(odd).collect()
    assert len(few) == len(odd_rows()) and {r["component_id"] for r in few if r["doc_id"] in (1, 2, 3)} == {1}
    left = near_dedup.deduplicated(odd)
    kept = collections.Counter(r["doc_id"] for r in left.collect())
    assert left.columns == odd.columns and kept[1] == 1 and not kept[2] and not kept[3] and kept[4] == kept[5] == kept[6] == 1 and kept[9] == 1 and not kept[10]
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.miss(near_dedup.TREES, near_dedup.START_LEVELS) < 1e-6


def test_all_pairs_of_a_large_node_meet(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, similarity.WIDTH)
    sigs = [np.where(rng.random(similarity.WIDTH) < 0.1, rng.integers(0, 256, similarity.WIDTH), base).astype(np.uint8).tobytes() for _ in range(40)]
    nodes = spark.createDataFrame([(1, i) for i in range(40)], "node long, item long")
    met = similarity.node_members(similarity.sized(nodes), spark.createDataFrame(list(enumerate(sigs)), "item long, sig binary"), limit=8)
    inside = collections.defaultdict(set)
    for r in met.collect():
        inside[r["node"]].add(r["item"])
    assert {(a, b) for m in inside.values() for a in m for b in m if a < b} == {(a, b) for b in range(40) for a in range(b)}


def test_held_against_blocks(spark):
    sets = {1: range(0, 100), 2: range(10, 105), 3: range(500, 600), 4: range(0, 99)}
    full = lambda items: items.join(spark.createDataFrame([(k, np.array(list(v), np.uint64).tobytes()) for k, v in sets.items()], "item long, content binary"), "item")
    members = spark.createDataFrame([(1, 7), (3, 7), (2, 2), (4, 4)], "item long, label long")
    asked = spark.createDataFrame([(2, 7), (4, 7)], "a long, label long")
    got = {tuple(r) for r in similarity.held_against(asked, members, full).collect()}
    assert got == {(2, 1), (4, 1)}


def test_substring_dedup(odd, none, docs):
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(odd).collect()}
    assert got[11]["n_removed"] == 0 and got[12]["n_removed"] >= 1
    passage = next(r[1] for r in odd_rows() if r[0] == 11).split("\n")[1]
    assert passage in got[11]["kept"] and passage not in got[12]["kept"]
    assert got[5]["kept"] == "" and got[4]["kept"] == "" and got[7]["n_removed"] == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert 1 - (1 - 0.8**substring_dedup.ROWS_PER_BAND) ** substring_dedup.tune_bands() >= substring_dedup.RECALL


def test_substring_dedup_inside_prose(spark):
    rng = random.Random(11)
    say = lambda n: " ".join("w%d" % rng.randrange(4000) for _ in range(n))
    passages = [say(50) for _ in range(20)]
    made = [(2 * i + k, say(rng.randint(20, 60)) + " " + p + " " + say(rng.randint(20, 60))) for i, p in enumerate(passages) for k in range(2)]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for k, text in made:
        gone = len(words(text)) - len(words(got[k]["kept"]))
        assert gone == 0 if k % 2 == 0 else 36 <= gone <= 50
        if k % 2:
            assert set(words(text)) - set(words(passages[k // 2])) <= set(words(got[k]["kept"]))


def test_substring_dedup_leaves_common_lines(spark):
    rng = random.Random(12)
    say = lambda n: " ".join("w%d" % rng.randrange(4000) for _ in range(n))
    line, passage = say(13) + ".", say(55)
    made = [(i, "\n".join([say(40), line, say(40) + " " + passage + " " + say(20)] if i % 2 else [say(60), line, say(25)])) for i in range(60)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    for i, text in made:
        gone = len(words(text)) - len(words(got[i]["kept"]))
        assert 41 <= gone <= 55 if i % 2 and i > 1 else gone == 0
    # a passage that is most of all text is frequent, and is found all the same
    docs = spark.createDataFrame([(i, say(20) + " " + passage + " " + say(20)) for i in range(60)], "doc_id long, text string").repartition(2)
    assert not substring_dedup.frequent_units(substring_dedup.cut_texts(docs)).isEmpty()
    kept = {r["doc_id"]: len(words(r["kept"])) for r in substring_dedup.substring_dedup(docs).collect()}
    assert kept.pop(0) == 95 and all(40 <= n <= 54 for n in kept.values())


def test_units_by_hand():
    rng = np.random.default_rng(5)
    hashes, first = rng.integers(0, 1 << 63, 400).astype(np.uint64), np.array([0, 10, 27, 27, 200, 400])
    at, run = substring_dedup.units(hashes, first)
    rows = [hashes[a:b] for a, b in zip(first, first[1:])]
    want = []
    for a, row in zip(first, rows):
        low = []
        for i in range(len(row) - substring_dedup.UNIT + 1):
            x = row[i : i + substring_dedup.UNIT]
            while len(x) > 1:
                x = core.combine(x[::2], x[1::2])
            low.append(int(x[0]) >> 32)
        for w in range(-substring_dedup.WINDOW + 1, len(low)):
            part = [(v, i) for i, v in enumerate(low) if w <= i < w + substring_dedup.WINDOW]
            want += [int(a) + min(part)[1]] if part else []
    assert sorted(set(want)) == at.tolist()


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, D)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and out.count() > 0


def twins(n=2048):
    """Two different words over a and b with equal polynomial hashes modulo a power of two, for any odd base (Thue and Morse)."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ab"[1 - b] for b in bits)


def test_words_and_pieces_that_a_polynomial_would_confuse(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = [(i, t) for n in (64, 512, 2048) for i, t in enumerate(twins(n), n)]
    data, offsets = core.text_buffers(pa.array([t for _, t in made]))
    assert len(np.unique(core.words(data, offsets)[0])) == len(made)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = tokens.Encoder(path).encode(pa.array([x for _, x in made]))
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for _, x in made]
    found = near_dedup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), shingle=2).collect()
    assert all(r["component_id"] == r["doc_id"] for r in found)


def test_pieces_of_one_hash(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "run_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["one two", "a" * 70 + " b", "a" * 69 + "c b", "", "one two"]
    got = tokens.Encoder(path).encode(pa.array(texts))
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids for x in texts]


def test_word_hashes_by_hand():
    rng = random.Random(6)
    made = ["".join(rng.choice("ab c\n") for _ in range(rng.randint(0, 300))) + "x" * rng.randint(0, 90) for _ in range(200)]
    data, offsets = core.text_buffers(pa.array(made))
    h, start, end, first = core.words(data, offsets)
    names = [w for t in made for w in words(t)]
    assert len(names) == len(h) and len({(n, x) for n, x in zip(names, h.tolist())}) == len(set(names)) == len(set(h.tolist()))
    assert np.diff(first).tolist() == [len(words(t)) for t in made]


def test_token_folder_is_read_without_its_writer(spark, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens.write_tokens(odd, path, folder=f"file://{tmp_path}/ids")
    segments, dictionary = tokens.open_tokens(spark.newSession(), f"file://{tmp_path}/ids")
    got = tokens.find_document(segments, dictionary, 9)
    assert got.tolist() == Tokenizer.from_file(path).encode("one", add_special_tokens=False).ids + [2]
    assert tokens.find_document(segments, dictionary, 77) is None
