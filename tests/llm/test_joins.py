"""Jaccard join, fingerprints, top-k and the pipeline against plain versions."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from graphweave.llm import common, components, fingerprints, language_id, ngram_join, packing, quality, secrets, shingles, topk
from graphweave.llm.shingles import shingle_sets


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def set_of(text, width):
    w = words_of(text)
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def slow_groups(rows, width, num, den=100):
    """Every pair compared; the smallest id of each group."""
    sets = [(i, set_of(t, width)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def mutated(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    """Groups of copies and near copies, chains, a passage that many share, short and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, rows = text(30), []
    for size in (12, 25, 60, 200):
        origin = text(size)
        rows += [origin] * rng.randint(1, 3) + [mutated(rng, origin, rng.randint(0, max(1, size // 25))) for _ in range(25)]
    chain = text(150)
    for _ in range(12):
        chain = mutated(rng, chain, 2)
        rows.append(chain)
    rows += [passage + " " + text(rng.randint(1, 40)) for _ in range(40)] + [text(rng.randint(1, 60)) for _ in range(60)]
    rows += [None, "", " \n", "one", "one", "ONE", "one two", "One Two", "é É", "É é"]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("seed, width, num, without_id", [(1, 3, 90, 0.3), (2, 5, 80, 0), (3, 2, 60, 0.5), (5, 1, 30, 0), (6, 2, 45, 0.2)])
def test_join_equals_all_pairs(spark, docs_of, monkeypatch, seed, width, num, without_id):
    """Rows without an id link others all the same; entries are split where they have more than a few members."""
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "SALTS", 3)
    monkeypatch.setattr(ngram_join, "SEEN", 10)
    rng = random.Random(seed)
    rows = [(None if rng.random() < without_id else i + 2**60, t) for i, t in corpus(seed)]
    found = ngram_join.JaccardJoin(docs_of(*rows), width, num, 100).membership().collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == slow_groups(rows, width, num)


def test_join_with_frequent_tokens(spark, docs_of, monkeypatch):
    """Few tokens are rare here, so pairs of frequent ones do the work."""
    monkeypatch.setattr(ngram_join, "PER_CLASS", 16)
    rows = corpus(4)
    join = ngram_join.JaccardJoin(docs_of(*rows), 3, 85, 100)
    join.counters = join.counters + 0
    original = ngram_join.Signatures.__init__

    def low(self, *args):
        original(self, *args)
        self.frequent = 1

    monkeypatch.setattr(ngram_join.Signatures, "__init__", low)
    found = join.membership().collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == slow_groups(rows, 3, 85)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.sampled_from([(90, 100), (80, 100), (60, 100), (45, 100), (30, 100), (20, 100)]), st.integers(0, 10**6), st.booleans())
def test_similar_sets_share_an_entry(size, threshold, seed, all_frequent):
    rng = np.random.default_rng(seed)
    num, den = threshold
    counters = rng.integers(0, 400, 1 << 10)
    signatures = ngram_join.Signatures(counters, num, den)
    if all_frequent:
        signatures.frequent = -1
    x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    kept = x[rng.random(len(x)) > rng.random() * (1 - num / den)]
    y = np.unique(np.concatenate([kept, rng.integers(0, 2**63, rng.integers(0, max(1, size // 8) + 1)).astype(np.uint64)]))
    inter = len(np.intersect1d(x, y))
    union = len(x) + len(y) - inter
    if union == inter or den * inter < num * union:
        return
    (a, miss_a), (b, miss_b) = signatures.of(x), signatures.of(y)
    shared = np.intersect1d(a, b)
    rooms = [min(len(x) - miss_a[a == s][0], len(y) - miss_b[b == s][0]) for s in shared]
    assert any(room * (num + den) >= num * (len(x) + len(y)) for room in rooms)
    differ = sum(int(np.bitwise_count(p ^ q)) for p, q in zip(ngram_join.parity(x).view(np.uint64), ngram_join.parity(y).view(np.uint64)))
    assert differ <= len(x) + len(y) - 2 * inter


def test_shingle_sets_of_odd_texts():
    texts = ["", "a", "A b", "a b c d", "x\0y z", "é É é É", "a\tb\x0bc\x0cd\re", "w " * 9000, "a b c", "y" * 9000]
    for width in (2, 3, 5):
        found = list(shingle_sets(texts, width))
        assert [len(f) for f in found] == [len(set_of(t, width)) for t in texts]
        assert [f.tolist() for f in shingle_sets(["zz"] + texts, width)][1:] == [f.tolist() for f in found]
    assert shingles.identity(found[1]) != shingles.identity(found[2])


def test_a_row_without_id_bridges(spark, docs_of):
    """Neighbours of three are similar, the outer two aren't; the one between has no id."""
    words = [f"w{k}" for k in range(62)]
    texts = [" ".join(words), " ".join(words[:58] + ["x"]), " ".join(words[:55] + ["y"])]
    sets = [set_of(t, 3) for t in texts]
    near = [len(a & b) / len(a | b) for a, b in zip(sets, [sets[1], sets[2], sets[0]])]
    assert min(near[:2]) >= 0.9 > near[2]
    found = ngram_join.JaccardJoin(docs_of((1, texts[0]), (None, texts[1]), (3, texts[2])), 3, 90, 100).membership().collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in found) == [(0, 1), (1, 1), (3, 1)]


def test_join_query(spark, docs_of, sf_path):
    """The query's own width and threshold, over a table with a column named as one of its own."""
    rows = corpus(7)
    found = ngram_join.op2_ngram_jaccard_join(spark, sf_path(documents=docs_of(*rows).withColumnRenamed("source", "component_id"))).collect()
    assert found[0].asDict().keys() == {"doc_id", "n_shingles", "component_id"}
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == slow_groups(rows, 3, 90)


def test_filter_loses_no_key(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *np.random.default_rng(4).integers(-(2**62), 2**62, 3000).tolist()]
    found = ngram_join.BitFilter.of(spark.createDataFrame([(k,) for k in keys], "key bigint"))
    assert found.passes(np.array(keys)).all()
    for spread in (1, 1 << 20, 1 << 33, 10**9):  # ids with a step let as few others pass
        own = ngram_join.BitFilter.of(spark.range(0, 3000 * spread, spread).toDF("key"))
        assert own.passes(np.arange(3000) * spread).all() and own.passes(np.arange(3000, 13000) * spread).mean() < 0.2
    assert found.passes(np.random.default_rng(1).integers(-(2**62), 2**62, 10_000)).mean() < 0.2


def test_join_edge_tables(spark, docs_of):
    assert ngram_join.JaccardJoin(docs_of().limit(0)).membership().count() == 0
    same = docs_of((3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None)).withColumnRenamed("source", "component_id")
    found = ngram_join.JaccardJoin(same).membership().collect()
    assert sorted(((r[0], r[2]) for r in found), key=str) == sorted([(3, 3), (3, 3), (None, 3), (None, None)], key=str)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)).filter(lambda e: e[0] != e[1]), max_size=60))
def test_components(spark, edges):
    frame = spark.createDataFrame([(min(e), max(e)) for e in edges], "u bigint, v bigint")
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["node"]: r["component"] for r in components.components(frame).collect()} == label


def edited(rows):
    out = {}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1] or "", len(t or "") // 2
        out[i] = (t or "")[: len(t or "") - half] + after[:half]
    return out


def test_fingerprint_query(spark, sf_path, docs_of):
    rng = random.Random(8)
    line = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(8)) + "."
    rows = [(3 * i, "\n".join(line() for _ in range(rng.randint(4, 30)))) for i in range(40)] + [(5000, rng.choice("é😀") * 5), (9000, None), (10**9, ""), (10**12, "x")]
    rows += [(200, rows[0][1])]
    found = {r["doc_id"]: r for r in fingerprints.op6_fingerprints(spark, sf_path(documents=docs_of(*rows))).collect()}
    texts = {i: t or "" for i, t in rows}
    for i, e in edited(rows).items():
        assert found[i]["n_chars"] == len(texts[i]) and found[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
    prints = Counter((texts[i], r["fingerprint"]) for i, r in found.items())
    assert len(prints) == len(set(texts.values())) == len({p for _, p in prints})
    own = [found[i] for i, t in rows[:40]]
    assert np.mean([r["near_edited"] > r["near_next"] + 0.1 for r in own]) > 0.9
    assert all(0 <= r[c] <= 1 for r in found.values() for c in ("near_edited", "near_next"))


def test_fingerprints_are_homomorphic(spark, docs_of):
    rows = docs_of((1, "a b\nc d. e"), (2, "c d. e\na b"), (3, "a b"), (4, "c d. e"), (5, "a b\na b\nc d. e"))
    v = {r["doc_id"]: list(r["vector"]) for r in fingerprints.fingerprints(rows).collect()}
    assert v[1] == v[2] != v[5]
    frame = spark.createDataFrame([(v[3], v[4], v[1])], "a array<bigint>, b array<bigint>, s array<bigint>")
    plus, minus = frame.select(fingerprints.combine(F.col("a"), F.col("b")), fingerprints.combine(F.col("s"), F.col("b"), -1)).first()
    assert list(plus) == v[1] and list(minus) == v[3]
    texts = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(rows).collect()}
    assert len(set(texts.values())) == 5  # the order counts for whole texts


def slow_vector(text):
    """Lanes from paragraphs, then the number of clauses and how many of them have each bit set; the clauses' hashes are Spark's."""
    lanes = [0] * fingerprints.LANES
    for paragraph in text.split("\n"):
        digits = hashlib.sha512(paragraph.encode()).hexdigest()
        lanes = [(x + int(digits[8 * k : 8 * k + 8], 16)) % 2**32 for k, x in enumerate(lanes)]
    return lanes, [c for c in (x.strip(" ") for x in regex.split(r"[^\p{L}\p{N} ]+", text)) if c]


def test_fingerprints_against_plain_ones(spark, docs_of, sf_path, monkeypatch):
    """Vectors, likenesses and order, with ids that repeat or are null, and equal rows."""
    monkeypatch.setattr(fingerprints, "COPIES", 2)
    rng = random.Random(11)
    text = lambda: "\n".join(", ".join(" ".join(rng.choices("abcdefgh", k=3)) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5)))
    rows = [(i, text()) for i in range(0, 60, 3)] + [(7, "x\ny"), (7, "y\nx"), (None, "no. id"), (None, "none"), (None, None), (2**62, "é😀é\n"), (-5, "- ! -")]
    rows += [(9, "same, twice")] * 6 + [(None, "")] * 4
    found = fingerprints.op6_fingerprints(spark, sf_path(documents=docs_of(*rows))).collect()
    hashes = {r["c"]: r["h"] for r in spark.createDataFrame([(c,) for _, t in rows for c in slow_vector(t or "")[1]] or [("",)], "c string").select("c", F.xxhash64("c", F.lit(-1)).alias("h")).collect()}
    texts = sorted((i is not None, i or 0, t or "") for i, t in rows)
    of_hash = {t: h for t, h in spark.createDataFrame([(t,) for t in {t for *_, t in texts}], "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted(texts, key=lambda r: (r[0], r[1], of_hash[r[2]]))
    head = lambda t: "".join(f"{x:08x}" for x in [*slow_vector(t)[0], len(slow_vector(t)[1])])

    def signs(t):
        clauses = slow_vector(t)[1]
        return np.array([2 * sum((hashes.get(c, 0) >> b) & 1 for c in clauses) - len(clauses) for b in range(fingerprints.SIGNS)], float)

    def near(one, other):
        a, b = signs(one), signs(other)
        norm = np.sqrt(a @ a * (b @ b))
        same = head(one) == head(other) and sorted(slow_vector(one)[1]) == sorted(slow_vector(other)[1])
        return 1.0 if same else max(0.0, a @ b / norm) if norm else 0.0

    wanted = Counter()
    for k, (named, i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][2], len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        wanted[i if named else None, len(t), hashlib.sha256(edit.encode()).hexdigest(), head(t), hashlib.sha256(t.encode()).hexdigest()[:32], head(edit), round(near(t, after), 9)] += 1
    size = len(head(""))
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"][:size], r["fingerprint"].split(":")[1], r["edited_fingerprint"][:size], round(r["near_next"], 9)) for r in found)
    assert got == wanted


def test_next_row_edges(spark, docs_of):
    ids = sorted(random.Random(3).sample(range(-(10**6), 10**6), 60)) + [2**62]
    rows = [(i, f"t{i}") for i in ids]
    found = {r["doc_id"]: r["next_head"] for r in fingerprints.with_next(docs_of(*rows).select("doc_id", "text")).collect()}
    assert found == {i: rows[(k + 1) % len(rows)][1][: len(rows[k][1]) // 2] for k, (i, _) in enumerate(rows)}
    assert fingerprints.with_next(docs_of((1, "ab")).select("doc_id", "text")).first()["next_head"] == "a"
    assert fingerprints.with_next(docs_of().limit(0).select("doc_id", "text")).count() == 0


def slow_top(rows, k):
    vectors = {}
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in kept:
        if q % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k(spark, sf_path, monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.normal(0, 0.2, (300, 12)).astype(np.float32)
    data[50:120] = data[50]  # many ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(400, None), (420, [None] * 12), (440, [float("nan")] * 12), (460, [float("inf")] + [0.0] * 11), (None, [0.1] * 12), (480, [0.0] * 12)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1))
    found = topk.op10_exact_top_k(spark, sf_path(embeddings=table)).collect()
    exact = [(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows]
    assert sorted(map(tuple, found)) == slow_top(exact, 20)
    frame = topk.quantised(table)
    small = topk.top_k(frame, frame.where("id % 20 = 0"), k=5, block_rows=70, block_queries=4).collect()
    assert sorted(map(tuple, small)) == [r for r in slow_top(exact, 5)]
    odd = [(0, [0.5, 0.5]), (1, [1.0]), (2, [1.0, -2.0]), (3, [0.25, 1.0]), (3, [0.25, 1.0]), (20, [4.0]), (40, []), (60, [1e300, 0.0]), (80, [2.0**24, 1.0]), (100, [2.0**25, -1.0])]
    mixed = topk.quantised(spark.createDataFrame(odd, "vec_id bigint, embedding array<double>"))
    of_width = [[(i, v) for i, v in odd if len(v) == n and max(map(abs, v)) < 2.3e7] for n in (1, 2)]
    assert sorted(map(tuple, topk.top_k(mixed, mixed.where("id % 20 = 0"), k=20, block_rows=2).collect())) == sorted(slow_top(of_width[0], 20) + slow_top(of_width[1], 20))
    none = topk.quantised(table.limit(0))
    assert topk.top_k(none, none).count() == 0
    few = topk.quantised(table.limit(3))
    assert topk.top_k(few, few.where("id = 0")).count() == 2


@pytest.fixture(scope="module")
def small_tables(spark, sf_dir):
    return sf_dir


def test_pipeline_stages(spark, small_tables, sf_path):
    docs = common.table(spark, small_tables, "documents")
    before = docs.toPandas()
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, small_tables), "test-stage")
        tables.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    good, known, single, clean, packed = (t.toPandas() for t in tables)
    # quality and language decide by the operators' own answers
    scores = quality.op5_quality_classifier(spark, small_tables).toPandas().set_index("doc_id")
    assert set(good.doc_id) == {i for i in before.doc_id if scores.predicted[i] == 1}
    langs = language_id.op3_language_id(spark, small_tables).toPandas().set_index("doc_id")
    assert set(known.doc_id) == {i for i in good.doc_id if langs.lang_pred[i] != "und" and langs.score[i] >= 0.5}
    groups = slow_groups(list(zip(known.doc_id, known.text)), 5, 80)
    assert sorted(single.doc_id) == sorted({c for _, _, c in groups})
    models = secrets.train(secrets.labelled_samples(common.table(spark, small_tables, "documents")))
    text = dict(zip(single.doc_id, single.text))
    for i, t in zip(clean.doc_id, clean.text):
        (spans,) = secrets.find([text[i]], models)
        assert (t == text[i]) == (not spans) and corpus_pipeline.REDACTED * bool(spans) in t
    assert set(packed.doc_id) == set(single.doc_id)
    total = int(packed.length.sum())
    assert packed.sequence_id.nunique() <= -(-total // packing.CAPACITY) + 1


def test_pipeline_run_and_odd_tables(spark, docs_of, sf_path, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    at = sf_path(documents=docs_of(*odd, lang={1: "en", 5: "en", 7: "en"}), labels=labels)
    assert corpus_pipeline.run(spark, at).count() > 0
    nothing = sf_path(documents=docs_of().limit(0), labels=labels.limit(0))
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_one_row_of_each_group_stays(spark, docs_of, odd):
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    found = stage(spark, docs_of(*odd), "")
    assert found.columns == corpus_pipeline.COLUMNS
    # id 5 with the text of id 1 goes, what has no words stays
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str) == sorted([r for r in odd if r != (5, odd[0][1])], key=str)
    one, two, three = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(9, one), (9, one), (4, one), (None, one), (None, two), (None, two), (8, three), (8, three), (8, two + " v"), (None, None), (None, None), (3, ""), (3, "")]
    # texts of 3 and 4 shingles that share 3 are below 0.8
    kept = [(4, one), (8, two + " v"), (None, two), (8, three), (None, None), (None, None), (3, ""), (3, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs_of(*rows), "").collect()), key=str) == sorted(kept, key=str)


def test_work_tables_relieve_the_driver(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    old = next(b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())  # counts whole collections

    def written(every, share):
        monkeypatch.setattr(common, "RELIEF_EVERY", every)
        monkeypatch.setattr(common, "HEAP_SHARE", share)
        monkeypatch.setattr(common, "_relieved", time.monotonic() if every else 0.0)
        before, trims = old.getCollectionCount(), []
        with monkeypatch.context() as patch:
            patch.setattr(common, "trim", lambda spark, f=common.trim: trims.append(f(spark)))
            assert common.materialize(spark.range(10), "relieved").count() == 10
        return old.getCollectionCount() - before, trims

    collections, trims = written(0.0, 0.0)
    assert collections and len(trims) == 1
    # a JVM of Linux that knows the command says what came of it
    assert trims[0] is None or "rim" in trims[0]
    collections, trims = written(0.0, 1.0)
    assert not collections and len(trims) == 1
    assert written(3600.0, 0.0) == (0, [])  # not again so soon


def test_long_texts_are_told_apart_before_their_sets_move(spark, docs_of):
    """Their bitmaps grow with them, and differ in width by what their sizes do; work tables with long rows are read row by row."""
    chance = random.Random(8)
    texts = [" ".join(str(chance.randrange(10**6)) for _ in range(n)) for n in (33_000, 32_000, 30_000, 40_000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10 + k, " ".join(t.split()[: len(t.split()) * 9 // 10])) for k, t in enumerate(texts)]
    join = ngram_join.JaccardJoin(docs_of(*rows), width=5, num=80, den=100)
    nodes = {r["doc_id"]: r["a"] for r in join.sets.collect()}
    pairs = spark.createDataFrame([(nodes[a], nodes[b]) for a in nodes for b in nodes if a < b], "x bigint, y bigint")
    found = {frozenset((r["x"], r["y"])) for r in join._near(pairs)[0].collect()}
    assert found == {frozenset((nodes[k], nodes[10 + k])) for k in range(4)}  # every link, and no other pair
    assert {r["doc_id"]: r["component_id"] for r in join.membership().collect()} == {i: i % 10 for i, _ in rows}
