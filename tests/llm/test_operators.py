import hashlib
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import LONG, odd_rows
from tidemark.llm import fingerprints, idfile, jaccard, kneser, language, lines, mixing, neighbours, packing, queries, substrings, tokens, words
from tidemark.llm.oracles import ORACLES

NAMES = list(queries.QUERIES)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Language


def brute_bits(text, counts, order):
    """Code length by following the contexts of every byte."""
    total, data = 0.0, b"\xff" * order + text.encode()
    for i in range(order, len(data)):
        for depth in range(order, -2, -1):
            if depth < 0:
                total += 8
                break
            context = data[i - depth : i]
            seen = counts.get((depth, context))
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if data[i] in seen:
                total += math.log2((n + kinds) / seen[data[i]])
                break
            total += math.log2((n + kinds) / kinds)
    return total


def test_code_lengths_are_exact(spark):
    texts = {"en": ["the cat sat on the mat", "a cat and a hat"], "fr": ["le chat est là", "la hache"]}
    rows = [(t, lang) for lang, own in texts.items() for t in own]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["en", "fr"]
    asked = ["the hat", "là", "zzz", "", "chat cat"]
    import pyarrow as pa

    got = model.code_lengths(pa.array(asked))
    for j, lang in enumerate(model.languages):
        counts = defaultdict(Counter)
        for text in texts[lang]:
            data = b"\xff" * language.ORDER + text.encode()
            for i in range(language.ORDER, len(data)):
                for depth in range(language.ORDER + 1):
                    counts[depth, data[i - depth : i]][data[i]] += 1
        for i, text in enumerate(asked):
            assert got[i, j] == pytest.approx(brute_bits(text, counts, language.ORDER), abs=1e-2)


def test_held_out_languages_are_found(spark, sf_dir):
    got = queries.op1_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert row.n > 20 and row.a >= 0.95
    assert got.where("score < 0 or score > 1").isEmpty()


def test_language_of_odd_rows(odd, nothing):
    model = language.fit(odd)
    got = language.predict(odd, model, odd.columns).toPandas()
    assert len(got) == len(odd_rows()) and list(got.columns) == [*odd.columns, "lang_pred", "score"]
    undetermined = got.loc[got.lang_pred == "und", "doc_id"]
    assert set(undetermined.dropna()) == {3, 4, 5, 9} and len(undetermined) == 5
    empty = language.fit(nothing)
    assert language.predict(odd, empty, ["doc_id"]).where("lang_pred <> 'und'").isEmpty()
    assert language.predict(nothing, model, ["doc_id"]).isEmpty()


def test_code_lengths_need_little_memory(spark):
    """Working memory is that of a block of bytes, not some bytes for each byte of a batch."""
    import tracemalloc

    import pyarrow as pa

    model = language.fit(spark.createDataFrame([("the cat sat on the mat", "en"), ("le chat", "fr")], "text string, lang string"))
    column = pa.array(["a cat on a mat " * 100, "", "le chat " * 150, ""] * 2500)  # some 6.7 MB
    model.code_lengths(column.slice(0, 4))
    tracemalloc.start()
    try:
        model.code_lengths(column.slice(0, 2500))
        quarter = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        model.code_lengths(column)
        more = tracemalloc.get_traced_memory()[1] - quarter
    finally:
        tracemalloc.stop()
    assert more < 3 * words.raw(column)[1][-1]


def test_code_lengths_over_many_blocks(spark):
    """Texts across the blocks' borders, among empty ones, have the lengths that they have alone."""
    import pyarrow as pa

    model = language.fit(spark.createDataFrame([("the cat sat on the mat", "en"), ("le chat", "fr")], "text string, lang string"))
    asked = ["", "the cat " * 70_000, "", None, "x", "", "le mat " * 200_000, "a", ""]
    got = model.code_lengths(pa.array(asked))
    for i, text in enumerate(asked):
        assert got[i] == pytest.approx(model.code_lengths(pa.array([text], pa.string()))[0], rel=1e-9)


def test_kept_text_is_sent_once(odd):
    """A text that is kept goes to the Python worker in one column; predictions are those of texts that aren't kept."""
    model = language.fit(odd)
    kept, alone = language.predict(odd, model, odd.columns), language.predict(odd, model, ["doc_id"])
    assert "_text" in alone._jdf.queryExecution().optimizedPlan().toString()
    assert "_text" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert Counter((r.doc_id, r.lang_pred) for r in kept.collect()) == Counter((r.doc_id, r.lang_pred) for r in alone.collect())


def test_training_sample_is_bounded(docs):
    small = language.training_sample(docs, rows=12, total_bytes=20_000)
    row = small.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    assert row.where("n > 3 or b > 5000").isEmpty() and not row.isEmpty()


def test_long_texts_do_not_end_a_sample(spark):
    """Every language stays in the model: long texts among short ones, long ones only, and many languages."""
    rows = [(f"un mot {i} " + "long " * (500 if i % 2 else 1), "fr") for i in range(40)]
    rows += [(f"{i} à" + "ß" * 3000, "de") for i in range(3)] + [("tiny", "en"), ("", "none"), (None, "none")]
    frame = spark.createDataFrame(rows, "text string, lang string")
    sample = language.training_sample(frame, rows=30, total_bytes=3000).collect()
    got = Counter(r.lang for r in sample)
    assert got == {"fr": 10, "de": 1, "en": 1}
    assert all(r.text in {t for t, _ in rows} for r in sample if r.lang != "de")
    assert all(len(r.text.encode()) <= 1000 for r in sample)
    assert language.fit(frame, total_bytes=3000).languages == ["de", "en", "fr"]
    many = spark.range(4000).selectExpr("concat('text ', id, repeat(' word', 3)) as text", "concat('l', id % 40) as lang")
    assert len(language.fit(many, rows=10, total_bytes=400).languages) == 40


# Token-id files


def test_blocks_round_trip():
    drawn = np.random.default_rng(0)
    for ids in (np.zeros(1), np.arange(5000) % 7, drawn.integers(0, 2**32, 4096), np.r_[drawn.integers(0, 50, 4000), 2**32 - 1]):
        ids = ids.astype(np.uint32)
        block = np.frombuffer(idfile.encode_block(ids), dtype=np.uint8)
        assert (idfile.decode_block(block) == ids).all()


def test_exceptions_keep_blocks_small():
    ids = np.r_[np.arange(4000) % 16, [2**31] * 40].astype(np.uint32)
    assert len(idfile.encode_block(ids)) < 4040 * 4 / 8 + 8 * 40 + 20


def expected_ids(rows, end):
    coder = tokens.encoder().tokenizer
    return [(i, [*coder.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows]


def test_id_files_hold_every_id(spark, docs, tmp_path):
    manifest = idfile.write(docs, 2, str(tmp_path), file_bytes=100_000)
    assert manifest.count() > 2
    got = sorted(map(tuple, idfile.read(manifest).drop("shard").collect()))
    start = 0
    for (doc, ids), row in zip(expected_ids(sorted(map(tuple, docs.select("doc_id", "text").collect())), 2), got, strict=True):
        assert row == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    reader = idfile.Reader(manifest.first().path)
    whole = reader.ids(0, reader.n_ids)
    assert (reader.ids(5, 9000) == whole[5:9000]).all() and len(reader.ids(3, 3)) == 0


def test_id_files_of_odd_rows(odd, nothing):
    got = idfile.read(idfile.write(odd, 2)).orderBy("start").collect()
    assert len(got) == len(odd_rows()) and [r.doc_id for r in got][:2] == [None, None]
    assert [r.n_tokens for r in got if r.doc_id in (3, 4, 5)] == [1, 1, 1]
    assert idfile.read(idfile.write(nothing, 2)).isEmpty()


# Jaccard join


def near_copies():
    drawn = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, common = [], " ".join(f"c{i}" for i in range(30))
    for base in range(12):
        text = list(drawn.choice(vocabulary, drawn.integers(3, 90)))
        for copy in range(int(drawn.integers(1, 14))):
            own = list(text)
            for _ in range(int(drawn.integers(0, 4))):
                own[int(drawn.integers(len(own)))] = str(drawn.choice(vocabulary))
            rows.append((len(rows), " ".join(own) + (" " + common if base % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize(("k", "percent", "group"), [(4, 85, jaccard.GROUP), (5, 80, 3), (2, 50, 3)])
def test_join_finds_every_component(spark, k, percent, group):
    rows = near_copies()
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent, group).collect()
    sets = {i: brute.shingles(t, k) for i, t in rows}
    want = brute.components(sets, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i, _ in rows}


def test_join_of_odd_rows(odd, nothing):
    got = jaccard.join_components(odd, 4, 85).collect()
    assert len(got) == len(odd_rows())
    of = {r.doc_id: r.component_id for r in got}
    assert of[1] == of[2] == of[11] == 1 and of[7] == of[8] == 7 and of[None] is None
    assert all(of[i] == i for i in (3, 4, 5, 6, 9, 10, 12))
    assert jaccard.join_components(nothing).isEmpty()


def unlinked_copies(n):
    """Copies of one text of 100 words, each with two to four words of its own: candidates, but few are similar."""
    drawn = np.random.default_rng(5)
    text, rows = [f"w{i}" for i in range(100)], []
    for i in range(n):
        own = list(text)
        for j in drawn.choice(100, int(drawn.integers(2, 5)), replace=False):
            own[j] = f"own{i}x{j}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("group", [jaccard.GROUP, 16])
def test_unlinked_copies_meet_in_few_groups(spark, group):
    rows, rule = unlinked_copies(240), jaccard.Rule(85)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = jaccard._candidates(jaccard.described(docs, 4, rule)).select("_id", "_key").collect()
    # With the smallest hash as the key, 191 copies had 38 groups, and each copy was joined with each group.
    assert len(near) > 150 and len({r._key for r in near}) <= 6
    got = jaccard.join_components(docs, 4, 85, group).collect()
    want = brute.components({i: brute.shingles(t, 4) for i, t in rows}, 85)
    assert {r.doc_id: r.component_id for r in got} == want


def test_frequent_shingles_are_told_from_a_large_inputs_usual_ones():
    counts = np.random.default_rng(1).poisson(8000, jaccard.COUNTERS)
    counts[:100] += 1000
    levels = jaccard._levels(counts)
    assert (levels[:100] >= 3).all() and np.median(levels) == 0
    assert not jaccard._levels(np.zeros(jaccard.COUNTERS)).any()


def test_only_wanted_texts_go_to_the_join(spark):
    rows = spark.range(20_000).selectExpr("if(id % 100 = 7, null, id) as _id", "repeat('a b ', 9) as text")
    wanted = spark.createDataFrame([(i,) for i in (0, 5, 5, 19_999, 1 << 40)], "_id long")
    kept = [r._id for r in jaccard._likely(rows.union(rows.where("_id = 5")), wanted).select("_id").collect()]
    assert {0, 5, 19_999} <= set(kept) and kept.count(5) == 2 and len(kept) < 30
    assert jaccard._likely(rows, wanted.where("false")).isEmpty()


def test_groups_of_long_sets_are_split_by_tokens(spark):
    rows = spark.range(40).selectExpr("id as _id", "7L as _key", f"{3 * jaccard.TOKENS} as _n")
    assert jaccard._chunked(rows, 20).select("_g").distinct().count() > 3
    assert jaccard._chunked(rows.drop("_n"), 40).select("_g").distinct().count() == 1


def test_prefix_lengths_are_enough():
    for percent in (50, 80, 85, 100):
        rule = jaccard.Rule(percent)
        for n in range(1, 60):
            for m in range(n, 60):
                for common in range(1, n + 1):
                    if 100 * common >= percent * (n + m - common):
                        need = min(rule.need(n), rule.need(m))
                        # The worst order: all that the sets don't share comes first.
                        assert rule.prefix(n) >= n - common + need and rule.prefix(m) >= m - common + need
                        assert rule.least(n) <= need and rule.least(m) <= need
    with pytest.raises(ValueError):
        jaccard.Rule(0)


# Repeated windows


@pytest.mark.parametrize("shard_bytes", [substrings.SHARD_BYTES, 500])
def test_repeated_windows_go(spark, shard_bytes):
    drawn = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(9)]
    texts = [" ".join([*drawn.choice(list("abcdefgh"), 30), *(passage if i % 2 else []), *drawn.choice(list("xyz"), 20)]) for i in range(12)]
    texts += ["r " * 12, None, "", "a b c"]
    got = substrings.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 6, shard_bytes).collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in sorted(got)] == brute.kept_words(texts, 6)
    for r in got:
        assert sum(i.last - i.first for i in r.intervals) == r.n_removed
        assert all(a.last < b.first for a, b in zip(r.intervals[:-1], r.intervals[1:], strict=True))


def test_a_passage_of_many_documents_is_no_large_group(spark):
    """A third of all documents share a passage: its windows reach their shard once a task, and all its words go."""
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, f"a{i} b{i} c{i} d{i} " + (passage if i % 3 == 0 else " ".join(f"u{i}x{j}" for j in range(12)))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = substrings.without_repeats(docs, 6, 2_000).collect()
    want = brute.kept_words([t for _, t in rows], 6)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == dict(enumerate(want))
    sent = substrings.sent_windows(docs.withColumn("_key", F.col("doc_id")), 6, 7).collect()
    hashes = Counter(h for r in sent if r.hashes is not None for h in np.frombuffer(bytes(r.hashes), np.uint64).tolist())
    places = sum(int(np.frombuffer(bytes(r.counts), "<u4").sum()) for r in sent if r.hashes is None)
    assert places == 300 * 7 and max(hashes.values()) <= 2
    assert sum(hashes.values()) == 900 * 11 - 300 * 7 + 2 * 7


def test_windows_of_odd_rows(odd, nothing):
    got = substrings.without_repeats(odd, 35).collect()
    texts = [r[1] for r in odd_rows()]
    want = Counter((r[0], *w) for r, w in zip(odd_rows(), brute.kept_words(texts, 35), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert substrings.without_repeats(nothing).isEmpty()


# Lines


def test_lines_on_many_sites_keep_their_first_place(spark):
    rows = [(i, f"own {i}\nshared line \n\nrare", f"s{i % 4 if i < 8 else 4}") for i in range(9)] + [(9, None, "s9"), (10, " shared line", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in lines.without_boilerplate(docs, min_sites=6).collect()}
    assert got[0].text == "own 0\nshared line \n\nrare" and got[0].lines_removed == 0
    assert got[5].text == "own 5\n\nrare" and (got[5].lines_total, got[5].lines_removed) == (4, 1)
    assert got[9].text is None and got[9].lines_total == 0 and got[10].text == ""
    all_gone = {r.doc_id: r.text for r in lines.without_boilerplate(docs, min_sites=6, keep_first=False).collect()}
    assert all_gone[0] == "own 0\n\nrare"
    assert lines.without_boilerplate(docs, min_sites=7).where("lines_removed > 0").isEmpty()


def test_many_sites_are_told_by_the_sketch(spark):
    sites = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("everywhere").alias("text"), F.col("id").cast("string").alias("source"))
    assert lines.boilerplate(sites, min_sites=1000).count() == 1
    assert lines.boilerplate(sites.where("doc_id < 999"), min_sites=1000).isEmpty()
    assert lines.boilerplate(sites.where("doc_id < 1000"), min_sites=1000).count() == 1


def test_lines_of_odd_rows(odd, nothing):
    got = lines.without_boilerplate(odd, min_sites=3)
    assert got.columns == [*odd.columns, "lines_total", "lines_removed"] and got.count() == len(odd_rows())
    assert lines.without_boilerplate(nothing).isEmpty()


# Language model


def test_kneser_ney_agrees_with_plain_python(spark):
    drawn = np.random.default_rng(1)
    texts = [" ".join(drawn.choice(list("abcdeFGH"), drawn.integers(0, 40), p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05])) for _ in range(60)]
    texts += [" ".join(f"n{i}" for i in range(j, j + 9)) for j in range(0, 40, 7)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = kneser.fit(frame, shard_bytes=300)
    asked = ["a b zz", "", None, "A f g H", "n1 n2 n3 n50", "unknown words only"]
    got = kneser.scored(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, ["doc_id"])
    got = {r.doc_id: r for r in got.collect()}
    sentences = [[*brute.words(brute.lower(t)), "</s>"] for t in texts]
    count, pair = Counter(w for s in sentences for w in s), Counter((a, b) for s in sentences for a, b in zip(["<s>", *s[:-1]], s, strict=True))
    before, total, kinds = Counter(b for _, b in pair), Counter(), defaultdict(Counter)
    for (a, _), n in pair.items():
        total[a] += n
        kinds[a][min(n, 3)] += 1
    dp, dw = (kneser.discounts(*(sum(n == k for n in c.values()) for k in (1, 2, 3, 4))) for c in (pair, before))
    rest = sum(dw[min(n, 3) - 1] for n in before.values()) / len(pair)

    def low(w):
        return (before[w] - dw[min(before[w], 3) - 1] if before[w] else 0) / len(pair) + rest / (len(count) + 1)

    def chance(a, w):
        if not total[a]:
            return low(w)
        left = sum(dp[k - 1] * kinds[a][k] for k in (1, 2, 3)) / total[a]
        return (pair[a, w] - dp[min(pair[a, w], 3) - 1] if pair[a, w] else 0) / total[a] + left * low(w)

    assert sum(chance("a", w) for w in [*count, "\0"]) == pytest.approx(1)
    for i, text in enumerate(asked):
        s = [*brute.words(brute.lower(text)), "</s>"]
        want = sum(math.log10(chance(a, w)) for a, w in zip(["<s>", *s[:-1]], s, strict=True))
        base = sum(math.log10((count[w] + 1) / (sum(count.values()) + len(count) + 1)) for w in s)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(s), sum(w in count for w in s), sum(count.values()))
        assert got[i].score == pytest.approx(want) and got[i].base_score == pytest.approx(base)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_longer_contexts_agree_with_plain_python(spark, order):
    drawn = np.random.default_rng(6)
    texts = [" ".join(drawn.choice(list("abcd"), drawn.integers(0, 30), p=[0.5, 0.3, 0.1, 0.1])) for _ in range(40)]
    sentences = [["<s>"] * (order - 1) + brute.words(t) + ["</s>"] for t in texts]
    value = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in sentences for i in range(order - 1, len(s)))}
    for m in range(order - 1, 0, -1):
        value[m] = Counter(g[1:] for g in value[m + 1])
    cut = {m: (0, *kneser.discounts(*(sum(n == k for n in v.values()) for k in (1, 2, 3, 4)))) for m, v in value.items()}

    def chance(gram):
        after = {g: n for g, n in value[len(gram)].items() if g[:-1] == gram[:-1]}
        lower = chance(gram[1:]) if len(gram) > 1 else 1 / (len(value[1]) + 1)
        if not after:
            return lower
        gone = cut[len(gram)]
        n, left = after.get(gram, 0), sum(gone[min(n, 3)] for n in after.values())
        return (n - gone[min(n, 3)] + left * lower) / sum(after.values())

    model = kneser.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shard_bytes=150, order=order)
    asked = ["a b a c", "", "d d zz a b", "b a a b c a"]
    got = kneser.scored(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, ["doc_id"]).collect()
    for r in got:
        s = ["<s>"] * (order - 1) + brute.words(asked[r.doc_id]) + ["</s>"]
        want = sum(math.log10(chance(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s)))
        assert r.score == pytest.approx(want)
    assert kneser.ORDER >= 3


@pytest.mark.parametrize("n", [0, 1, 500, 60_000])
def test_sorted_arrays_find_what_was_stored(n):
    drawn = np.random.default_rng(n)
    keys = np.unique(drawn.integers(0, 1 << 63, n, dtype=np.uint64))
    columns = [drawn.integers(0, 400, len(keys)), drawn.integers(0, 1 << 40, len(keys)), np.zeros(len(keys), dtype=np.int64)]
    order = drawn.permutation(len(keys))
    data = np.frombuffer(b"".join(kneser._packed(keys[order], [c[order] for c in columns])), dtype=np.uint8)
    asked = np.concatenate([keys[::3], drawn.integers(1 << 63, 1 << 64, 1000, dtype=np.uint64)])
    asked = asked[drawn.permutation(len(asked))]
    of = dict(zip(kneser._low(keys).tolist(), zip(*(c.tolist() for c in columns), strict=True), strict=True))
    want = [of.get(k, (0, 0, 0)) for k in kneser._low(asked).tolist()]
    packed = kneser._Packed(data, 3)
    assert [tuple(v) for v in packed.find(asked).T.tolist()] == want
    assert dict(zip(packed.keys().tolist(), zip(*(c.tolist() for c in packed.all()), strict=True), strict=True)) == of
    assert len(data) < 6.5 * n + 16 * sum(int((c >= 255).sum()) for c in columns) + 3 * n + 100_000


def test_language_model_of_odd_rows(odd, nothing, spark, sf_dir):
    model = kneser.fit(odd)
    got = kneser.scored(odd, model, odd.columns)
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() == len(odd_rows())
    assert got.where(f"text is null and n_tokens <> 1").isEmpty()
    unknown = kneser.scored(odd, kneser.fit(nothing), ["doc_id"]).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in unknown)
    assert kneser.scored(nothing, model, ["doc_id"]).isEmpty()
    better = queries.op6_kneser_ney(spark, sf_dir).where("held_out").agg(F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()[0]
    assert better > 0.9


# Mixing


def test_targets_reshare_what_is_over_the_cap(spark):
    rows = [("a", 10), ("b", 1000), ("c", 100), ("d", 0), (None, 500), ("e", 300)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, "e": 2, None: 3}
    size = dict(rows)
    fixed = set()
    while True:
        level = (1910 - sum(3 * size[s] for s in fixed)) / sum(w for s, w in weight.items() if s not in fixed)
        over = {s for s, w in weight.items() if s not in fixed and w * level > 3 * size[s]}
        if not over:
            break
        fixed |= over
    for s in size:
        assert got[s] == pytest.approx(3 * size[s] if s in fixed else weight[s] * level)


def test_mix_meets_its_targets(spark, sf_dir):
    got = queries.op7_entropy_mix(spark, sf_dir)
    assert got.count() == 200 and got.where("taken > 3 * size or source_size < size").isEmpty()
    per = got.groupBy("source", "source_size", "target").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).collect()
    assert all(r.s == r.source_size and abs(r.t - r.target) <= max(60, 0.02 * r.target) for r in per)
    again = queries.op7_entropy_mix(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_priors_tilt_rates_and_the_cap_holds(spark):
    rows = [("a", 1.0, 100.0), ("a", 4.0, 100.0), ("b", 1.0, 50.0)]
    masses = spark.createDataFrame(rows, "source string, prior double, mass double")
    goals = spark.createDataFrame([("a", 400.0), ("b", 150.0)], "source string, target double")
    lam = {r.source: math.exp(r._lam) for r in mixing.multipliers(masses, goals).collect()}
    assert 100 * min(3, lam["a"]) + 100 * min(3, 4 * lam["a"]) == pytest.approx(400) and lam["a"] == pytest.approx(1)
    assert min(3, lam["b"]) == pytest.approx(3)


def test_mix_of_odd_rows(odd, nothing):
    got = mixing.mixed(odd)
    assert got.columns == odd.columns
    words = odd.agg(F.sum(mixing.word_count())).first()[0]
    taken = got.agg(F.sum(mixing.word_count())).first()[0]
    assert 0 < taken <= 3 * words
    assert mixing.mixed(nothing).isEmpty()


# Fingerprints


def test_edited_texts_and_likeness(spark, docs):
    got = {r.doc_id: r for r in fingerprints.compared(docs).collect()}
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()), reverse=True)
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        assert (got[doc].n_chars, got[doc].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = brute.shingles(text, 5), brute.shingles(edited, 5)
        assert got[doc].near_edited == pytest.approx(len(a & b) / max(1, len(a | b)), abs=0.2)
    prints = defaultdict(set)
    for doc, text in rows:
        prints[text].add(got[doc].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_neighbours_meet_across_buckets(docs):
    whole = sorted(map(tuple, fingerprints.compared(docs).select("doc_id", "edited_sha256").collect()))
    buckets = fingerprints.in_neighbourhoods(docs, bucket_bytes=20_000)
    assert buckets.select("_bucket").distinct().count() > 10
    pairs = {}
    for bucket in {r._bucket for r in buckets.select("_bucket").distinct().collect()}:
        own = [r for r in buckets.where(F.col("_bucket") == bucket).collect()]
        own.sort(key=lambda r: (r._lent, -r.doc_id))
        assert [r._lent for r in own] == [0] * (len(own) - 1) + [1]
        pairs.update((a.doc_id, b.doc_id) for a, b in zip(own[:-1], own[1:], strict=True))
    ids = sorted((i for i, _ in whole), reverse=True)
    assert pairs == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_minima_are_those_of_all_functions():
    """Signatures against 128 functions applied to every shingle in plain Python."""
    import pyarrow as pa

    texts = ["one two three four five six seven", "a b", "", "One TWO three four five", LONG[:4000]]
    hashed, bounds = words.hashed(pa.array(texts), lower=True)
    factor, summand = (x.tolist() for x in fingerprints._functions(fingerprints.PERMUTATIONS))
    for own, row in zip(words.shingle_sets(hashed, bounds, fingerprints.SHINGLE), fingerprints.signatures(pa.array(texts)), strict=True):
        want = [min([((f * s + a) % 2**64) >> 32 for s in own.tolist()] or [2**32 - 1]) for f, a in zip(factor, summand, strict=True)]
        assert row.tolist() == want


def test_fingerprints_of_odd_rows(odd, nothing):
    got = fingerprints.compared(odd).collect()
    assert len(got) == len(odd_rows()) and sum(r.n_chars == 0 for r in got) == 3
    assert next(r for r in got if r.doc_id == 7).n_chars == len(LONG)
    assert fingerprints.compared(nothing).isEmpty()


def test_near_duplicates_by_bands(spark, odd, nothing):
    rows = near_copies()
    got = fingerprints.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3).collect()
    want = brute.components({i: brute.shingles(t, 3) for i, t in rows}, 80)
    assert {r.doc_id: r.component_id for r in got} == want
    of = {r.doc_id: r.component_id for r in fingerprints.near_duplicates(odd).collect()}
    assert of[1] == of[2] == of[11] == 1 and of[7] == of[8] == 7 and of[3] == 3 and of[None] is None
    assert fingerprints.near_duplicates(nothing).isEmpty()


@pytest.mark.parametrize("group", [2, 3])
def test_chunks_of_a_band_are_compared(spark, group):
    """Chains of texts, each alike the next only, and near copies: bands of more than ``group`` sets are split."""
    chain = [(100 + i, " ".join(f"t{j}" for j in range(6 * i, 6 * i + 120))) for i in range(12)]
    rows = near_copies() + chain
    got = fingerprints.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, group=group).collect()
    want = brute.components({i: brute.shingles(t, 3) for i, t in rows}, 80)
    assert {r.doc_id: r.component_id for r in got} == want and want[111] == 100


# Nearest neighbours


@pytest.mark.parametrize("sf,least", [("sf0.001", 0.9), ("sf0.1", 0.95)])  # 10 and 40 queries
def test_recall_and_exact_scores(spark, sf, least):
    sf_dir = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = defaultdict(list)
    for r in sorted(queries.op9_multiprobe(spark, sf_dir).collect()):
        found[r.query_id].append(r)
    assert set(found) == {i for i in ids.tolist() if i % 50 == 0}
    hits = 0
    for q, own in found.items():
        score = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -score))].tolist() if i != q][:5]
        hits += len(set(best) & {r.vec_id for r in own})
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(score[ids == r.vec_id][0] - r.score) < 1e-12 for r in own)
    assert hits / 5 / len(found) >= least


def test_blocks_get_each_vector_once_a_table(spark, sf_dir):
    """What a search shuffles: the index sends a vector as often as there are tables, in its own precision."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert neighbours._kind(rows, "embedding") == "<f4" and neighbours.TABLES <= 3
    assert len(neighbours.usable(rows, "vec_id", "embedding").first()._v) == 4 * 64


def test_odd_vectors(spark, nothing):
    ones = [1.0, 2.0]
    rows = [(0, ones), (1, [2.0, 4.0]), (2, [2.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0])]
    rows += [(7, [float("inf"), 1.0]), (8, [-1.0, 1.0]), (None, ones), (9, [1.0]), (8, [-1.0, 1.0]), (10, [1e300, 2e300]), (50, [])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = neighbours.nearest(frame, F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1), (0, 2), (0, 10), (0, 8)]
    assert neighbours.nearest(frame.where("vec_id in (3, 4)"), F.col("vec_id") > 0).isEmpty()
    many = spark.createDataFrame([(i, [1.0, 1.0 + (i % 50 == 7)]) for i in range(300)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(many, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]


# Packing


def test_least_squares_is_not_worse_than_projected_descent():
    drawn = np.random.default_rng(2)
    a, b = drawn.random((12, 40)), drawn.random(12) * 10
    x = packing.least_squares(a, b)
    y = np.zeros(40)
    for _ in range(20_000):
        y = np.maximum(0, y - 0.005 * a.T @ (a @ y - b))
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6


def test_patterns_fill_a_sequence():
    found = packing.patterns(16, 4)
    middles = found @ (np.arange(16) + 0.5)
    assert (middles <= 16).all() and (middles > 15).all() and (found.sum(axis=1) <= 4).all()
    assert len(np.unique(found, axis=0)) == len(found)


def check_packing(rows, docs, end=1):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= 4096
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for doc, ids in expected_ids(docs, end):
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert got == want
    return len(by)


def test_packing_is_whole_and_tight(spark, docs, sf_dir):
    rows = queries.op10_patterns(spark, sf_dir).collect()
    used = check_packing(rows, docs.select("doc_id", "text").collect())
    assert used <= math.ceil(sum(r.length for r in rows) / 4096) * 1.1 + 1


def test_packing_of_many_lengths():
    drawn = np.random.default_rng(4)
    lengths = np.minimum(4096, drawn.lognormal(6.5, 1.0, 20_000).astype(int) + 1)
    shapes, repeats = packing.fitted(np.bincount((lengths - 1) // 64, minlength=64).astype(float))
    place, _ = packing.pack(lengths, shapes, np.floor(repeats).astype(int), 4096)
    assert len(set(place)) <= 1.005 * lengths.sum() / 4096 + 1


def test_packing_of_odd_rows(odd, nothing):
    check_packing(packing.packed(packing.cut(odd, 1)).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert packing.packed(packing.cut(nothing, 1)).isEmpty()
    extra = packing.packed(packing.cut(odd, 1).withColumn("_part", F.lit("x")).withColumn("offset", F.lit(9)))
    assert "_part" in extra.columns and extra.columns[-2:] == ["sequence_id", "offset"]


# Queries and pipeline


@pytest.mark.parametrize("name", [n for n in NAMES if n in ORACLES])
def test_query_agrees_with_sql(spark, sf_dir, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES if n.startswith("op")) == list(range(1, 14))


def test_a_shards_ngrams_are_copied_once():
    rng = np.random.default_rng(0)
    blobs, want = [], []
    for n in [50_000] * 8 + [0]:
        columns, count = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(3)], rng.integers(1, 300, n)
        blobs.append(kneser._written(columns, [count]))
        want.append([*columns, count])
    tracemalloc.start()
    columns, values = kneser._read_words(blobs, 3, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for got, parts in zip([*columns, *values], zip(*want, strict=True), strict=True):
        assert (got == np.concatenate(parts)).all()
    assert peak < 1.4 * sum(a.nbytes for a in [*columns, *values])
