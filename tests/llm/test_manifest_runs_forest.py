import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import LONG, odd_rows
from tidemark.llm import forest, keys, manifest, periodic, queries, words

# Manifest

VALUES = ["doc_id", "source", "lang", "n_chars", "text"]


def by_text(rows):
    return sorted(map(tuple, rows), key=repr)


def test_manifest_against_plain_trees(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*VALUES).collect()]
    assert by_text(queries.op11_interval_manifest(spark, sf_dir).collect()) == by_text(brute.manifest(rows))


@pytest.mark.parametrize("stride", [1, 2, 4])
def test_strides_give_the_same_trees(spark, stride):
    """Sources of 1 to 200 leaves: lone leaves, whole trees, last runs of one and of two."""
    rows = [(i, f"s{n}", None, None, f"t{i}\n{n}") for n in (1, 2, 3, 4, 9, 10, 27, 28, 82, 200) for i in range(1000 * n, 1000 * n + n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    made = manifest.build(docs, VALUES, "source", "doc_id", {"doc_id": F.col("doc_id"), "now": manifest.leaf([F.col(v) for v in VALUES])}, stride=stride)
    got = manifest.checked(made, "now", ["doc_id"])
    want = {r[0]: r for r in brute.manifest(rows)}
    assert got.where("not verified").isEmpty()
    assert {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256) for r in got.collect()} == {i: w[1:5] for i, w in want.items()}
    # Nodes cover their leaves without gaps, level by level.
    for level in made.nodes.groupBy("_tree", "_level").agg(F.sum(F.col("_hi") - F.col("_lo")).alias("n"), F.max("_leaves").alias("of")).collect():
        assert level.n == level.of
    # A proof of some leaves alone.
    some = made.leaves.where("doc_id % 7 = 0")
    paths = made.proofs(some).collect()
    assert len(paths) == some.count()
    for r in paths:
        assert manifest.fold(bytes(r._path), bytes(r._digest))[0] == made.root


def test_manifest_of_odd_rows(spark, odd, nothing):
    def of(df):
        made = manifest.build(df, VALUES, "source", "doc_id", {"doc_id": F.col("doc_id"), "now": manifest.leaf([F.col(v) for v in VALUES])})
        return manifest.checked(made, "now", ["doc_id"]).collect()

    got = of(odd)
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows()]
    want = brute.manifest(rows)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.proof_sha256) for r in got) == Counter((w[0], w[1], w[2], w[4]) for w in want)
    assert all(r.verified for r in got) and of(nothing) == []
    many = spark.createDataFrame([(7, "s", "x")] * 50, "doc_id long, source string, text string")
    made = manifest.build(many, ["doc_id", "text"], "source", "doc_id")
    assert made.leaves.count() == 50 and made.leaves.select("_at").distinct().count() == 50
    assert made.proofs().select("_path").distinct().count() > 1


# Periodic runs


def coded(texts):
    hashed = np.array([hash(("w", w)) & (2**63 - 1) for t in texts for w in t], dtype=np.uint64)
    return hashed, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=5), st.integers(0, 2**31))
def test_runs_against_all_periods(texts, seed):
    drawn = random.Random(seed)
    texts = [t + t[:n] * drawn.randrange(8) + t[n:] for t in texts for n in [drawn.randrange(6)]]
    got = sorted(zip(*(c.tolist() for c in periodic.runs(*coded(texts))), strict=True))
    assert got == [(i, *r) for i, t in enumerate(texts) for r in brute.runs(t)]


def test_suffixes_are_sorted():
    drawn = random.Random(3)
    texts = [[drawn.randrange(3) for _ in range(drawn.randrange(30))] for _ in range(20)]
    hashed, bounds = coded(texts)
    found = periodic.Suffixes(hashed, bounds)
    rank = {c: i for i, c in enumerate(sorted(set(hashed.tolist())))}
    for t, (start, end) in enumerate(zip(found.starts, found.ends, strict=True)):
        own = [rank[h] for h in hashed[bounds[t] : bounds[t + 1]].tolist()]
        at = [i - start for i in found.order.tolist() if start <= i <= end]
        assert at == sorted(range(len(own) + 1), key=lambda i: own[i:])


def test_periods_of_long_texts(monkeypatch):
    """One word a million times, a long period, and pairs tested in several pieces."""
    monkeypatch.setattr(periodic, "PAIRS", 1000)
    of, start, length, period = periodic.runs(np.zeros(300_000, dtype=np.uint64), np.array([0, 300_000]))
    assert (of.tolist(), start.tolist(), length.tolist(), period.tolist()) == ([0], [0], [300_000], [1])
    once = np.arange(1, 10_001, dtype=np.uint64)
    long = np.r_[np.uint64(0), np.tile(once, 5)[:-17], np.uint64(0)]
    assert [c.tolist() for c in periodic.runs(long, np.array([0, len(long)]))] == [[0], [1], [49_983], [10_000]]


def test_periodic_query_against_brute_force(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert set(got) == set(rows) and sum(r[1] > 0 for r in got.values()) > 10
    for doc_id, text in rows.items():
        if len(text or "") < 6000:
            assert got[doc_id] == brute.periodic(doc_id, text)


def test_periodic_runs_of_odd_rows(spark, odd, nothing):
    got = periodic.find(odd, ["doc_id", "score", "lines_total"]).collect()
    assert len(got) == len(odd_rows()) and not any(r.runs for r in got)
    assert Counter((r.doc_id, r.collapsed) for r in got) == Counter((r[0], " ".join(brute.words(r[1]))) for r in odd_rows())
    assert periodic.find(nothing, ["doc_id"]).isEmpty()
    rows = [(1, "a b " * 10 + "c"), (1, "a b " * 10 + "c"), (2, "x " * 5), (3, "x " * 6), (4, "y\n" * 40_000), (5, LONG + " " + "q\t" * 9)]
    found = periodic.find(spark.createDataFrame(rows, "runs long, text string"), ["runs"]).toDF("id", "runs", "collapsed").collect()
    runs = {r.id: [tuple(x) for x in r.runs] for r in found}
    assert runs == {1: [(0, 20, 2)], 2: [], 3: [(0, 6, 1)], 4: [(0, 40_000, 1)], 5: [(20_000, 9, 1)]}
    text = {r.id: r.collapsed for r in found}
    assert text[1] == "a b c" and text[3] == "x" and text[4] == "y" and text[5] == LONG + " q"


def test_planted_stretches(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 60))) for i in range(400)] + [(None, "a b c"), (20, None), (20, " \n")]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", periodic.planted(F.col("doc_id"), F.col("text")).alias("p")).collect()
    for doc_id, text, planted in got:
        if (text or "").strip():
            assert brute.periodic(doc_id, text)[6:] == brute_of(planted)
        else:
            assert planted == text


def brute_of(text):
    own, found, gone = brute.runs(brute.words(text)), brute.words(text), set()
    for start, length, q in own:
        gone.update(range(start + q, start + length))
    return brute.digest("".join(f"{a},{b},{c}\n" for a, b, c in own)), brute.digest(" ".join(w for i, w in enumerate(found) if i not in gone))


# Projection forest


def clustered(seed=5, size=48, labels=3, per=700):
    """Vectors of their own and clusters whose members lie near the limit of a link, or far above it."""
    drawn = np.random.default_rng(seed)
    rows = []
    for label in range(labels):
        x = drawn.standard_normal((per, size))
        for c, noise in enumerate((0.15, 0.25, 0.3, 0.02)):
            x[60 * c : 60 * c + 60] = x[60 * c] / np.linalg.norm(x[60 * c]) + noise / np.sqrt(size) * drawn.standard_normal((60, size))
        x[300:320] = x[300]
        rows += [(label * per + i, v.astype(np.float32).tolist(), label) for i, v in enumerate(x)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("settings_", [{"leaf": 64}, {"leaf": 16, "chunk": 40, "trees": 6}, {"leaf": 10_000}])
def test_forest_against_all_pairs(spark, settings_):
    rows = clustered()
    got = sorted(map(tuple, forest.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(7), **settings_).collect()))
    want = sorted(brute.linked(rows))
    links, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all_links > 10_000 and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert links >= 0.9 * all_links and [g[0] for g in got] == [w[0] for w in want]
    if settings_["leaf"] == 10_000:  # one leaf: all pairs
        assert got == want
    else:
        assert links >= 0.97 * all_links
        assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.9 * len(want)


def test_leaves_split_the_vectors():
    drawn = np.random.default_rng(1)
    x = forest.unit(drawn.standard_normal((4000, 32)))
    made = forest.Forest(x[:1000], 32)
    row, node = made.leaves(x @ made.directions, np.full(4000, 5), 0)
    assert set(row.tolist()) == set(range(4000)) and node.min() >= 32 and node.max() < 64
    sizes = np.bincount(node)[32:]
    assert 4000 < sizes.sum() <= 4000 * forest.PLACES and sizes.max() < 4000 * forest.PLACES / 8
    assert np.bincount(row).max() <= forest.PLACES
    deep, nodes = made.leaves(x[:50] @ made.directions, np.full(50, 20), 1)  # below the nodes that were fitted
    assert nodes.min() >= 1 << 20 and set(deep.tolist()) == set(range(50))


def test_forest_query_agrees_with_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, queries.op13_projection_forest(spark, sf_dir).collect())) == sorted(brute.linked(rows))


def test_forest_of_odd_vectors(spark):
    ones = [1.0, 2.0]
    rows = [(0, ones, 1), (1, [2.0, 4.0], 1), (2, [2.0, 4.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1)]
    rows += [(7, [float("inf"), 1.0], 1), (8, [-1.0, 1.0], 1), (None, ones, 1), (9, [1.0], 1), (8, [-1.0, 1.0], 1), (10, [1e300, 2e300], 1)]
    rows += [(50, [], 1), (51, ones, None), (52, ones, 2), (53, [1.0], 1), (None, [5.0, -5.0], 2)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links string, _c int")
    got = forest.near_duplicates(frame)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == Counter(brute.linked(rows))
    assert forest.near_duplicates(frame.limit(0)).isEmpty()
    assert sorted(map(tuple, forest.near_duplicates(frame.where("vec_id in (3, 4)")).collect())) == [(3, 0, 3, True), (4, 0, 4, True)]


# Keys and words


def test_row_keys_differ_where_rows_do(spark):
    """Eight bits for thirty rows: hashes agree, keys don't."""
    rows = [(i % 29, None if i % 3 == 0 else f"t{i % 29}") for i in range(29)] + [(7, None), (None, "7"), (7, None)]
    frame = spark.createDataFrame(rows, "a long, b string")
    key = keys.row_key(frame, [F.col("a"), F.col("b")], bits=8)
    got = frame.select("a", "b", key.alias("k")).collect()
    assert len({r.k for r in got}) == len({(r.a, r.b) for r in got}) == len(set(rows))


def test_a_long_word_takes_little_memory():
    import tracemalloc

    text = pa.array(["x" * (40 << 20) + " y"])
    data, bounds = words.raw(text)
    starts, ends, _ = words.spans(data, bounds)
    tracemalloc.start()
    got = words.hashes(data, starts, ends)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20 and len(set(got.tolist())) == 2
    tracemalloc.stop()
