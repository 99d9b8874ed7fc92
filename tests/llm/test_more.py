"""Second half of the operators' tests: brute-force values, order, recall, priors, stages on odd and empty tables, clashing names."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborlens.llm import core, decontam, fingerprint, mixing, near_dedup, quality, sharding, substring_dedup

from .test_operators import D, SCHEMA, WORD, odd_rows, words


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def targets_by_hand(sizes):
    """Water filling: share by weight among sources that are not full, again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 3 * sizes[s] + 1e-9]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= set(full)
    return out


def test_targets_by_hand(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {rng.choice("abcdefghij") + str(i): rng.choice([0, 1, 5, 100, 5000]) for i in range(rng.randint(1, 8))}
        sizes |= {None: rng.randint(0, 50)} if rng.random() < 0.5 else {}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = targets_by_hand(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in got)


def test_mix_sizes_by_hand(docs):
    got = {r["doc_id"]: r for r in mixing.mixed_sizes(docs).collect()}
    sizes = collections.Counter()
    for r in docs.collect():
        n = len(WORD.findall(r["text"] or ""))
        assert got[r["doc_id"]]["size"] == n and got[r["doc_id"]]["taken"] % max(n, 1) == 0
        sizes[r["source"]] += n
    assert all(r["source_size"] == sizes[r["source"]] for r in got.values())


def test_shards_are_runs_of_the_curve(docs):
    got = sharding.shard(docs, shards=6).collect()
    total = len(got)
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in order] == sorted(r["curve_index"] for r in got)
    assert all(r["shard"] == i * 6 // total for i, r in enumerate(order))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8
    place = {r["doc_id"]: i for i, r in enumerate(order)}
    same = collections.defaultdict(list)
    for k, t in texts.items():
        same[t].append(place[k])
    assert all(max(v) - min(v) == len(v) - 1 for v in same.values())


def test_shard_dimensions_tell_long_names_apart(spark):
    rows = spark.createDataFrame([(i, f"text {i}", "en", f"https://host{i % 8}.org") for i in range(160)], "doc_id long, text string, lang string, source string")
    marked = rows.join(sharding.shard(rows, shards=8).select("doc_id", "shard"), "doc_id")
    assert marked.groupBy("source").agg(F.count_distinct("shard").alias("n")).agg(F.avg("n")).first()[0] < 3


def test_copies_in_a_share_of_all_rows(spark):
    rows = spark.createDataFrame([(i, "same text" if i % 2 else f"text {i}", "en", "s") for i in range(400)], "doc_id long, text string, lang string, source string").repartition(5)
    counts = rows.withColumn("k1", F.xxhash64("text")).groupBy("k1").agg(F.count("*").alias("copies"))
    assert core.hot_keys(counts, ["k1"]).count() == 1
    got = sharding.shard(rows, shards=4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400)) and set(collections.Counter(r["shard"] for r in got).values()) == {100}
    left = spark.createDataFrame([(i % 3, i) for i in range(300)], "k long, v long")
    about = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k long, t string")
    hot = spark.createDataFrame([(0,)], "k long")
    for how in ("inner", "left"):
        want = collections.Counter(tuple(r) for r in left.join(about, "k", how).select("k", "v", "t").collect())
        assert collections.Counter(tuple(r) for r in core.join_copies(left, about, ["k"], "v", hot, how).select("k", "v", "t").collect()) == want


def test_fingerprint_values_by_hand(docs):
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    made = fingerprint.sums([r["text"] for r in rows])
    for i, r in enumerate(rows):
        g, after = got[r["doc_id"]], (i + 1) % len(rows)
        assert g["n_chars"] == len(r["text"]) and g["fingerprint"] == made[i].tobytes().hex()
        edited = np.frombuffer(bytes.fromhex(g["edited_fingerprint"]), np.uint8)[None]
        assert math.isclose(g["near_edited"], fingerprint.likeness(made[i : i + 1], edited)[0]) and math.isclose(g["near_next"], fingerprint.likeness(made[i : i + 1], made[after : after + 1])[0])
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r["text"]].add(got[r["doc_id"]]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({x for v in by_text.values() for x in v}) == len({"\n".join(sorted(t.split("\n"))) for t in by_text})


def test_fingerprint_counts_beyond_16_bits():
    line = "same words here"
    a, b = fingerprint.sums(["\n".join([line] * 40_000)]), fingerprint.sums(["\n".join([line] * 39_000)])
    assert 0.9 < fingerprint.likeness(a, b)[0] < 1
    assert (fingerprint.combined(a, fingerprint.sums(["\n".join([line] * 1_000)]), -1) == b).all()


def test_risk_is_non_negative_and_prior_found():
    rng = np.random.default_rng(3)
    make = lambda n, at: rng.normal(at, 1, (n, 6)).astype(np.float32)
    p, u = make(800, 1.2), np.concatenate([make(600, 1.2), make(1400, -1.2)])
    model = quality.fit(p, u, 0.3, steps=300)
    score = lambda x: ((x - model["mean"]) / model["scale"]) @ model["w"][:-1] + model["w"][-1]
    assert (score(make(500, 1.2)) > 0).mean() > 0.95 and (score(make(500, -1.2)) < 0).mean() > 0.95
    assert abs(model["pu_prior"] - 0.3) < 0.06
    # with a prior far too high the negative part would fall below zero; the correction keeps the fit from calling everything positive
    high = quality.fit(p, u, 0.9, steps=300)
    z = ((u - high["mean"]) / high["scale"]) @ high["w"][:-1] + high["w"][-1]
    s_u = 1 / (1 + np.exp(-z))
    z = ((p - high["mean"]) / high["scale"]) @ high["w"][:-1] + high["w"][-1]
    s_p = 1 / (1 + np.exp(-z))
    negative = -np.log1p(-np.minimum(s_u, 1 - 1e-12)).mean() + 0.9 * np.log1p(-np.minimum(s_p, 1 - 1e-12)).mean()
    assert negative > -0.05


def test_unlabelled_prior_by_hand():
    p = np.linspace(1, 2, 1000)
    assert abs(quality.unlabelled_prior(p, np.concatenate([p[::2], -p, -p])) - 0.2) < 0.01


def test_quality_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 0), (7, 0, 1), (11, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    assert quality.scored(odd, model).count() == len(odd_rows()) and quality.scored(none, model).count() == 0
    assert "constant" in quality.train(none, labels) and "constant" in quality.train(odd, labels.limit(0))
    named = odd.withColumn("score", F.lit(1))
    with pytest.raises(ValueError):
        quality.scored(named, model)
    name = quality.free_name(named, "score")
    assert name == "_score" and quality.scored(named, model, name).columns == [*named.columns, "_score"]


def test_latent_retrieval_beats_plain_words(spark, docs):
    """A window of a paraphrase is nearer to its passage after the projection than as plain TF-IDF among all its words."""
    rng = random.Random(4)
    hosts = [r["text"].split() for r in docs.collect() if len(r["text"].split()) > 120][:40]
    items = [(k, " ".join(rng.sample(h, 40)), None) for k, h in enumerate(hosts[:20])]
    every = np.unique(np.concatenate(decontam.item_words([t for _, t, _ in items])))
    seen, n = decontam.frequencies(docs, every)
    model = decontam.build(spark, items, every, seen, n)
    for k in range(10):
        told = [w if rng.random() < 0.8 else "new%d" % rng.randrange(999) for w in items[k][1].split()] + rng.sample(hosts[k + 20], 40)
        h = decontam.item_words([" ".join(told)])[0]
        at = np.searchsorted(model["vocabulary"], h)
        known = model["vocabulary"][np.minimum(at, len(model["vocabulary"]) - 1)] == h
        plain = np.bincount(at[known], minlength=len(model["vocabulary"]))
        idf = np.log((1 + n) / (1 + seen[np.searchsorted(every, model["vocabulary"])])) + 1
        folded = (plain @ model["weighted"]) / max(np.linalg.norm(plain @ model["weighted"]), 1e-9)
        latent = model["folded"] @ folded
        rows = [np.bincount(np.searchsorted(model["vocabulary"], decontam.item_words([t])[0]), minlength=len(plain)) * idf for _, t, _ in items]
        flat = plain * idf
        cosine = np.array([r @ flat / np.linalg.norm(r) / np.linalg.norm(flat) for r in rows])
        assert latent.argmax() == k and latent[k] >= cosine[k] - 1e-5


def test_decontamination_in_several_passes(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    want = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK_PASSAGES", 8)
    monkeypatch.setattr(decontam, "MODEL_BYTES", 1 << 16)
    monkeypatch.setattr(decontam, "VOCABULARY", 400)
    assert len(list(decontam._models(docs, bench))) > 2
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()} == want
    kept = {r["doc_id"] for r in decontam.decontaminated(docs, bench).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {k for k, _ in want}


def test_decontamination_of_empty_tables(spark, none):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    assert decontam.leaks(none, bench).count() == 0 and decontam.decontaminated(none, bench).count() == 0
    assert decontam.leaks(none, bench.limit(0)).count() == 0


def test_near_duplicates_at_the_threshold(spark):
    """Pairs at 80 of 100 shingles and a bit above are all found; those just below are not linked."""
    rng = random.Random(5)
    made, pairs = [], []
    for k in range(150):
        w = ["w%d_%d" % (k, i) for i in range(rng.randint(60, 140))]
        n = len(w) - 1
        # with c words replaced at the end the sets share n - c of n + c shingles
        c = int(n * (0.10 if k % 2 else 0.125))
        pairs.append((2 * k, 100 * (n - c) >= 80 * (n + c)))
        made += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: len(w) - c] + ["v%d_%d" % (k, i) for i in range(c)]))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(4), shingle=2).collect()}
    assert all((got[a + 1] == a) == linked for a, linked in pairs) and sum(x for _, x in pairs) > 50


def passages_by_hand(made, size):
    """Words of each document that stand in a run of `size` words also found earlier (smaller doc_id, or before it)."""
    first = {}
    for k, text in sorted(made):
        w = words(text)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), (k, i))
    out = {}
    for k, text in made:
        w = words(text)
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] != (k, i):
                hit[i : i + size] = True
        out[k] = hit
    return out


def test_substring_recall_against_all_passages(docs):
    """Of the words that stand in repeated passages of 50 words, nearly all go; documents without a repeated run of 16 words lose nothing."""
    made = [(r["doc_id"], r["text"]) for r in docs.collect()]
    long_, short = passages_by_hand(made, 50), passages_by_hand(made, 16)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    due = sum(int(h.sum()) for h in long_.values())
    gone = sum(min(int(long_[k].sum()), len(words(t)) - len(words(got[k]["kept"]))) for k, t in made)
    assert due > 1000 and gone / due > 0.8
    caught = [got[k]["n_removed"] > 0 for k, _ in made if long_[k].any()]
    assert sum(caught) / len(caught) > 0.97
    clean = [got[k]["n_removed"] == 0 for k, _ in made if not short[k].any()]
    assert sum(clean) / len(clean) > 0.95
    for k, t in made:
        rest = got[k]["kept"]
        assert got[k]["kept_sha256"] == hashlib.sha256(rest.encode()).hexdigest() and got[k]["removed_bytes"] == len(t.encode()) - len(rest.encode())


def test_run_of_spans():
    raw = b" ".join(b"w%d" % i for i in range(100))
    at = lambda i, j: {"lo": raw.index(b"w%d" % i), "hi": raw.index(b"w%d" % j) + 3, "sure": False}
    assert substring_dedup._kept_runs(raw, [at(10, 25)], 32) == []
    assert len(substring_dedup._kept_runs(raw, [at(10, 25), at(20, 45)], 32)) == 1
    assert len(substring_dedup._kept_runs(raw, [at(10, 25), at(30, 45)], 32)) == 2
    assert substring_dedup._kept_runs(raw, [at(10, 25), at(60, 75)], 32) == []
    assert len(substring_dedup._kept_runs(raw, [{**at(10, 25), "sure": True}], 32)) == 1


STAGE_NAMES = ["quality", "near_duplicates", "decontamination", "mix", "shards"]


def test_pipeline_stages_on_odd_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    extra = {"score": F.lit(1), "_k1": F.lit("k"), "_d": F.lit(2.0), "one": F.lit("o"), "row": F.lit("r"), "copies": F.lit(0), "keys": F.lit(0), "blank": F.lit(False)}
    named = odd.withColumns(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == STAGE_NAMES
    for name, stage in corpus_pipeline.STAGES:
        for table, size in ((named, len(odd_rows())), (none.withColumns(extra), 0)):
            out = stage(spark, table, D)
            if name == "shards":
                assert out.count() == size
                continue
            assert out.columns == table.columns and out.schema == table.schema
            rows = out.collect()
            assert (len(rows) <= size or name == "mix") and all(r["_k1"] == "k" and r["score"] == 1 for r in rows)


def test_pipeline_by_hand(spark):
    """Each stage against its operator's own statement, on the rows the one before kept."""
    import corpus_pipeline

    docs, bench = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = core.stored(stages["quality"](spark, docs, D), "t")
    model = quality.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.scored(docs, model).where("score >= 0.5").collect()}
    unique = core.stored(stages["near_duplicates"](spark, kept, D), "t")
    sets = {r["doc_id"]: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for r in kept.collect() if (w := words(r["text"]))}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    blank = {r["doc_id"] for r in kept.collect()} - set(sets)
    assert {r["doc_id"] for r in unique.collect()} == {k for k in sets if find(k) == k} | blank
    clean = core.stored(stages["decontamination"](spark, unique, D), "t")
    exact = {r["doc_id"] for r in unique.collect() for b in bench.collect() if b["text"] in (r["text"] or "")}
    left = {r["doc_id"] for r in clean.collect()}
    assert not left & exact and {r["doc_id"] for r in unique.collect()} - left == {r["doc_id"] for r in decontam.leaks(unique, bench).collect()}
    mixed = core.stored(stages["mix"](spark, clean, D), "t")
    want = collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect() if r["copies"]})
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == want
    out = corpus_pipeline.run(spark, D).collect()
    assert collections.Counter(r["doc_id"] for r in out) == want
    counts = collections.Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in counts.items())


def test_every_query_has_a_test_or_sql():
    from arborlens.llm import queries

    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_word_chunks_of_any_size():
    column = pa.array(["a b", None, "", "x" * 5000 + " y", "ü ö"])
    got = [core.words(d, o)[0] for _, d, o in core.chunks(*core.text_buffers(column))]
    assert len(np.concatenate(got)) == 6


def test_pairs_of_a_large_group_of_near_copies_grow_with_its_size(spark, monkeypatch):
    from arborlens.llm import similarity

    rng = np.random.default_rng(6)
    base = np.arange(1000, 1400, dtype=np.uint64)
    # 120 near copies and one apart, in three nodes of all of them.
    sets = {i: np.unique(np.concatenate([base[rng.random(400) > 0.02], np.array([i], np.uint64)])) for i in range(120)} | {120: base + np.uint64(5000)}
    low = similarity.minwise(np.concatenate(list(sets.values())), np.array([len(x) for x in sets.values()])).astype(np.uint8)
    sigs = spark.createDataFrame([(i, bytearray(low[i].tobytes())) for i in sets], "item long, sig binary")
    content = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "item long, content binary")
    # One member differs, so that the nodes are told apart.
    nodes = spark.createDataFrame([(n, i) for n in range(3) for i in sets if i != n], "node long, item long")
    monkeypatch.setattr(similarity, "NODE_LIMIT", 20)
    monkeypatch.setattr(similarity.node_members, "__defaults__", (0, 20))
    met, made = [], similarity.candidates
    monkeypatch.setattr(similarity, "candidates", lambda members, *rest: met.append(members.count()) or made(members, *rest))
    roots = similarity.clusters(nodes, sigs, lambda items: content.join(items, "item", "left_semi"))
    got = {r["node"]: r["root"] for r in roots.collect()}
    assert got == {i: 0 for i in range(120)}
    # Each of the 360 members is compared in one share of its node.
    assert met[0] == 360


def test_many_components_that_are_nearly_similar_make_no_pairs(spark, monkeypatch):
    from arborlens.llm import similarity

    # Any two share 300 of 410, a candidate that does not hold, but for 200 and 77, which are like 3 and 8.
    common, own = np.arange(1000, 1300, dtype=np.uint64), np.arange(55, dtype=np.uint64)
    sets = {i: np.concatenate([common, own + np.uint64(10_000 * (i + 1))]) for i in range(200)}
    sets[200] = np.concatenate([sets[3][:-20], own[:20] + np.uint64(5_000_000)])
    sets[77] = np.concatenate([sets[8][:-10], own[:10] + np.uint64(6_000_000)])
    low = similarity.minwise(np.concatenate(list(sets.values())), np.array([len(x) for x in sets.values()])).astype(np.uint8)
    sigs = spark.createDataFrame([(i, bytearray(low[i].tobytes())) for i in range(201)], "item long, sig binary")
    content = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "item long, content binary")
    nodes = spark.createDataFrame([(1, i) for i in sets], "node long, item long")
    full = lambda items: content.join(items, "item", "left_semi")
    want = {i: {200: 3, 77: 8}.get(i, i) for i in sets}
    rows, made = [], similarity.candidates

    def counted(*args):
        out = made(*args)
        rows.append(out.count())
        return out

    for held in (similarity.HELD_BYTES, 0):
        rows.clear()
        monkeypatch.setattr(similarity.joined, "__defaults__", (held,))
        monkeypatch.setattr(similarity, "candidates", counted)
        got = {r["node"]: r["root"] for r in similarity.clusters(nodes, sigs, full).collect()}
        assert {k: got.get(k, k) for k in sets} == want
        if held:
            # One row for each member at most, and one for the node.
            assert sum(rows) <= len(sets) + 1
    # What is beyond the bytes of a task is still compared, as rows.
    assert len(rows) == 2 and rows[1] > len(sets)
