"""Odd rows, hot keys and samples: what earlier tests of the corpus operators leave out."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import components, decontaminate, knn_quality, label_shards, prefix_hash, queries, recurrent_lm, simhash_dedup, token_counts, toxic_cnn, url_lists

WORDS = [a + b for a in ("ri", "sto", "mor", "wal", "un", "bri", "qui", "gar") for b in ("ver", "ne", "ning", "ked", "der", "ght", "et", "den", "lo", "sa")]
PAIR = "doc_id long, text string"


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_crowded_is_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(components, "ROWS_OF_A_KEY", 5)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 40 + [2, 2, 3, 9])], "k long, row long")
    facts = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 9").withColumn("fact", F.col("k") * 10)
    got = components.join_crowded(rows, facts, ["k"], "n", 44, how)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(facts, ["k"], how).collect()))


def test_score_beats_the_base_on_unseen_texts(spark, tmp_path):
    rng = random.Random(6)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}
    rows = []
    for i in range(1200):
        text = [rng.choice(WORDS)]
        for _ in range(60):
            text.append(rng.choice(follow[text[-1]]))
        rows.append((i, " ".join(text)))
    held = knn_quality.crc_remainder("doc_id", 10) == 0
    found = recurrent_lm.score_documents(spark.createDataFrame(rows, PAIR).repartition(4), held, str(tmp_path / "lm")).filter("held_out").collect()
    assert len(found) > 80 and sum(r["score"] for r in found) > sum(r["base_score"] for r in found)
    assert np.mean([r["score"] > r["base_score"] for r in found]) > 0.9


@pytest.mark.parametrize("n, rows", [(1, 8), (7, 8), (33, 8), (1000, 8), (1003, 64)])
def test_every_token_is_a_target_once(monkeypatch, n, rows):
    seen = collections.Counter()

    class Told:
        def __init__(self, network): ...

        def window(self, h, ids, keep, told):
            seen.update(ids[told].tolist())
            return h

    monkeypatch.setattr(recurrent_lm, "Trainer", Told)
    recurrent_lm.train_part(None, np.arange(n, dtype=np.int32), rows, np.ones(n, np.float32))
    assert seen == collections.Counter(range(n))


def test_token_cache_is_met_again(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"text {i % 7}") for i in range(30)], PAIR).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("lamina.token.cache", f"{tmp_path}/cache")
    try:
        first = sorted(queries.op2_token_counts(spark, str(tmp_path)).collect())
        monkeypatch.setattr(token_counts, "_counter", lambda path: lambda texts: 1 / 0)  # nothing is encoded any more
        assert sorted(queries.op2_token_counts(spark, str(tmp_path)).collect()) == first
        assert spark.read.parquet(f"{tmp_path}/cache").count() == 7
        spark.read.parquet(f"{tmp_path}/cache").write.mode("append").partitionBy("version").parquet(f"{tmp_path}/cache")  # every key twice
        assert sorted(queries.op2_token_counts(spark, str(tmp_path)).collect()) == first
        token_counts.compact_cache(spark, f"{tmp_path}/cache", f"{tmp_path}/small")
        assert spark.read.parquet(f"{tmp_path}/small").count() == 7
    finally:
        spark.conf.unset("lamina.token.cache")


def test_cells_give_the_number_of_cuts_above():
    rng = random.Random(4)
    for cuts in ([0], [5, 5, 9], [-(1 << 63), 7, (1 << 63) - 1], [rng.randrange(-(10**6), 10**12) for _ in range(300)]):
        cuts = sorted(set(cuts))
        cells, shift = prefix_hash.cut_cells(cuts)
        held = {c: (above, own) for c, above, own in cells}
        assert len(cells) <= 4 * len(cuts) + 3
        for rank in [*cuts, *[c + 1 for c in cuts if c < (1 << 63) - 1], *[rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)]]:
            above, own = held[max(min(held), min(max(held), rank >> shift))]
            assert above + sum(c > rank for c in own) == sum(c > rank for c in cuts)


def test_fingerprints_of_ids_that_repeat_or_are_no_numbers(spark):
    rows = [("7", "a" * 40), ("7", "b" * 40), ("x", "c" * 40), (None, "d" * 40), ("900", "e" * 40)]
    found = prefix_hash.fingerprint_documents(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["7", "7", "900", "None", "None"] and len({r["edited_sha256"] for r in found}) == 5


def test_sample_is_bounded_and_takes_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, "copy %d" % (i % 9), "clash") for i in range(3000)] + [(i, f"text {i}", "clash") for i in range(2, 200)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(1, 1, 1)] * 50 + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    sample = knn_quality.labelled_sample(docs, labels, "quality", 40).collect()
    assert len(sample) <= 40 and len({(r["doc_id"], r["label"]) for r in sample}) == len(sample)
    assert sum(r["label"] for r in sample) == 20  # ids without a document take no place
    for score in (knn_quality.score_quality, toxic_cnn.score_toxicity):
        assert score(docs, labels).count() == docs.count()
        with pytest.raises(ValueError):
            score(docs.withColumn("score", F.lit(1)), labels, keep=("doc_id", "score"))


def test_long_labelled_texts_are_learned_from(spark, monkeypatch):
    rng = random.Random(2)
    long = [(i, " ".join(words(rng, 12_000) + ["scumbag"] * (i % 2))) for i in range(40)]  # above 64 KiB
    docs = spark.createDataFrame(long, PAIR)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    taught = toxic_cnn.fitting_sample(docs, labels, "toxic")
    assert len(taught) == 40
    monkeypatch.setattr(toxic_cnn, "SAMPLE_BYTES", sum(len(t) for _, t in long) // 2)
    some = toxic_cnn.fitting_sample(docs, labels, "toxic")
    assert 15 <= len(some) <= 20 and {r["doc_id"] for r in some} < set(range(40))


def test_convolution_by_definition():
    rng = np.random.default_rng(7)
    embedding = rng.normal(size=(toxic_cnn.BUCKETS, toxic_cnn.AXES)).astype(np.float32)
    filters = [rng.normal(size=(w, toxic_cnn.AXES, toxic_cnn.FILTERS)).astype(np.float32) for w in toxic_cnn.WIDTHS]
    biases = [rng.normal(size=toxic_cnn.FILTERS).astype(np.float32) for _ in toxic_cnn.WIDTHS]
    out, bias = rng.normal(size=toxic_cnn.FILTERS * len(filters)).astype(np.float32), np.array([-0.3], np.float32)
    texts = ["", "one", "alpha beta", "Wide, words: gather gathering gathers", " ".join(words(random.Random(1), 300))]
    got, _ = toxic_cnn.Scorer((embedding, filters, biases, out, bias)).probabilities(texts)
    for text, p in zip(texts, got, strict=True):
        rows = []
        for word in toxic_cnn.plain_words(text):
            own = toxic_cnn.buckets_of(word)
            rows.append(sum(embedding[b] for b in own) / max(1, sum(b > 0 for b in own)))
        rows = rows or [np.zeros(toxic_cnn.AXES)]
        peaks = []
        for width, filt, b in zip(toxic_cnn.WIDTHS, filters, biases, strict=True):
            padded = rows + [np.zeros(toxic_cnn.AXES)] * width
            for k in range(toxic_cnn.FILTERS):
                peaks.append(max(0.0, max(sum(float(padded[i + j] @ filt[j, :, k]) for j in range(width)) for i in range(len(rows))) + float(b[k])))
        z = sum(a * float(c) for a, c in zip(peaks, out, strict=True)) + float(bias[0])
        assert math.isclose(p, 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-3, abs_tol=1e-6)


def test_short_items_are_found_whole(spark):
    benchmark = spark.createDataFrame([(1, "Zyx"), (2, "odd pair"), (3, "three odd words"), (4, "four odd words here"), (5, ""), (6, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a zyx, b"), (2, "the odd pair"), (3, "odd and pair"), (4, "x three odd words"), (5, "three odd cats words"), (6, "four odd words"), (7, "zyx " * 20_000)], PAIR)
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(1, 1): 1.0, (2, 2): 1.0, (4, 3): 1.0, (7, 1): 1.0}


def test_contamination_as_by_aligning_every_pair(spark):
    rng = random.Random(8)
    items = [(i, words(rng, rng.randint(6, 25))) for i in range(15)]
    rows = []
    for i in range(60):
        text = words(rng, 30)
        if i % 2:
            text[10:10] = [w if rng.random() > 0.25 else rng.choice(WORDS) for w in items[i % 15][1]]
        rows.append((i, text))
    expected = set()
    for d, text in rows:
        for i, item in items:
            a, b = [w.encode() for w in item], [w.encode() for w in text]
            grams = {tuple(b[k : k + 4]) for k in range(len(b) - 3)}
            if any(tuple(a[k : k + 4]) in grams for k in range(len(a) - 3)) and decontaminate.align(a, b)[0] >= len(a):
                expected.add((d, i))
    docs, benchmark = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], PAIR), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()} == expected and len(expected) > 15


def jaccard(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("segments", [None, (8, 2, 26, 6)])
def test_links_at_the_limit_are_found_and_none_below(spark, segments):
    """400 pairs from exactly 0.8 to 0.85 and as many just below, against counting."""
    rng, rows, above, below = random.Random(10), [], [], []
    for i in range(800):
        n = rng.choice([60, 120, 200, 400])
        text = words(rng, n)
        other, k = list(text), 0
        while jaccard(text, other) > (0.85 if i % 2 else 0.8):
            other[(7 * k + 3) % n] = f"o{i}x{k}"
            k += 1
        if i % 2 == 0:
            other = list(other) if jaccard(text, other) < 0.8 else other
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
        (above if jaccard(text, other) >= 0.8 else below).append(i)
    docs = spark.createDataFrame(rows, PAIR).repartition(4)
    cut = segments and simhash_dedup.Segments(*segments)
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(docs, segments=cut).collect()}
    share = np.mean([found[2 * i] == found[2 * i + 1] for i in above])
    assert share >= 0.95 and not any(found[2 * i] == found[2 * i + 1] for i in below), share
    assert len(above) > 250 and len(below) > 200


def test_strangers_in_a_crowded_entry_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CROWDED", 3)
    monkeypatch.setattr(simhash_dedup, "STRANGERS", 2)
    monkeypatch.setattr(simhash_dedup, "SORTED", 4)
    rng = random.Random(3)
    base = words(rng, 200)
    rows = []
    for i in range(40):  # all share most of their words, neighbours only are above the limit
        base = list(base)
        base[(5 * i) % 200] = f"n{i}"
        rows.append((i, " ".join(base)))
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(spark.createDataFrame(rows, PAIR)).collect()}
    assert set(found.values()) == {0}


def test_shards_of_very_long_and_hot_texts(spark):
    rows = [(i, "hot") for i in range(900)] + [(1000 + i, f"own {i}") for i in range(500)] + [(2000, "long " * 200_000)]
    found = label_shards.shard_documents(spark.createDataFrame(rows, PAIR), shards=5).collect()
    sizes = collections.Counter(r["shard"] for r in found)
    assert len(found) == 1401 and max(sizes.values()) - min(sizes.values()) <= 1


def test_frequent_patterns_are_sent(spark, monkeypatch):
    monkeypatch.setattr(url_lists, "FREQUENT", 3)
    entries = spark.createDataFrame([("l", "com", "block", "2024-01-10"), ("l", "a.com", "allow", "2024-01-01"), ("m", "b.com", "block", "2024-01-01")], "list string, pattern string, action string, dated string")
    seen = [(i, f"http://h{i}.{'ab'[i % 2]}.com/x", "2024-01-%02d" % (i + 1)) for i in range(20)]
    captures = spark.createDataFrame([*seen, (99, "http://x.org/" + "y" * 100_000, "2024-01-01")], "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date"))
    got = {r["page_id"]: r["lists"] for r in url_lists.evaluate(captures, entries.withColumn("dated", F.col("dated").cast("date"))).collect()}
    assert got == {i: "" if i % 2 == 0 else "l,m" if i >= 9 else "m" for i in range(20)} | {99: ""}
    with pytest.raises(ValueError):
        url_lists.evaluate(captures.withColumn("lists", F.lit("")), entries, keep=("page_id", "lists"))


def planted(spark, folder):
    rng = random.Random(21)
    rows = [(i, " ".join(words(rng, 80)), "en", "s", 1) for i in range(120)]
    rows += [(i, rows[i][1], "en", "s", 1) for i in range(0, 60, 3)]  # rows equal in all columns
    rows += [(500 + i, rows[i][1], "fr", "t", 2) for i in range(1, 60, 3)]  # equal texts
    items = [(i, " ".join(words(rng, 20))) for i in range(3)]
    rows += [(700 + i, t + " " + " ".join(words(rng, 40)), "en", "s", 1) for i, t in items] + [(700, items[0][1] + " x y", "en", "s", 1)]
    rows += [(None, None, None, None, None), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "ocean " * 30_000, "en", "s", 3), (None, "no number here at all", None, "s", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(24).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


@pytest.mark.parametrize("stage", ["near_duplicates", "decontamination"])
def test_stages_don_t_depend_on_how_files_are_split(spark, tmp_path, stage):
    rows = planted(spark, str(tmp_path))
    run, name = dict(corpus_pipeline.STAGES)[stage], "spark.sql.leafNodeDefaultParallelism"
    found = []
    try:
        for first, then in ((2, 64), (64, 2)):
            spark.conf.set(name, first)
            docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("row", F.lit("clash")).withColumn("component_id", F.lit(1))
            out = run(spark, docs, str(tmp_path))
            spark.conf.set(name, then)  # cores come and go between the readings
            found.append(sorted(map(str, out.collect())))
    finally:
        spark.conf.unset(name)
    assert found[0] == found[1]
    counts = collections.Counter(r[0] for r in run(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect())
    if stage == "near_duplicates":
        assert {n for k, n in counts.items() if k != 700} == {1} and not set(counts) & set(range(501, 560, 3)) and counts[900] == 1 and 901 not in counts and counts[902] == 1 and counts[None] == 1
    else:
        assert not set(counts) & {700, 701, 702} and sum(counts.values()) == len(rows) - 4 and counts[0] == 2


def test_all_stages_take_odd_rows(spark, tmp_path):
    planted(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["round_trip"] for r in out) and {r["doc_id"] for r in out} >= set(range(120)) | {900, 902}


def test_blocks_of_a_cluster_link_what_counting_links(spark, monkeypatch):
    """One template with more and more changes: components as by comparing all pairs, with one and with many blocks."""
    rng, base = random.Random(5), words(random.Random(5), 150)
    texts = [" ".join(w if rng.random() > share else rng.choice(WORDS) for w in base) for share in [0.005, 0.01, 0.02, 0.04, 0.06] for _ in range(24)]
    sets = [t.split() for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    docs = spark.createDataFrame(list(enumerate(texts)), PAIR)
    for block in (1 << 22, 1 << 13):
        monkeypatch.setattr(simhash_dedup, "BLOCK", block)
        found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(docs).collect()}
        assert [found[i] for i in range(len(sets))] == [root(i) for i in range(len(sets))]


def test_toxicity_is_learned_from_all_labelled_rows(spark, monkeypatch):
    """Forty bad words, each in a few texts: a sample of SAMPLE rows would miss most of them."""
    monkeypatch.setattr(toxic_cnn, "SAMPLE", 60)
    rng = random.Random(7)
    bad = ["".join(rng.choice("bcdfgkmptz") for _ in range(9)) for _ in range(40)]
    texts = [" ".join(words(rng, 30) + ([bad[i // 2 % 40]] if i % 2 else [])) for i in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), PAIR)
    labels = spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, toxic int")
    rows = toxic_cnn.labelled_rows(docs.unionByName(docs.filter("doc_id < 9")), labels.unionByName(labels.filter("doc_id = 3")), "toxic")
    assert sorted(r["doc_id"] for r in rows.collect()) == list(range(800))
    found = toxic_cnn.score_toxicity(docs, labels.filter("doc_id < 640")).filter("doc_id >= 640").collect()
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in found) >= 0.95 * len(found)


def test_labelled_texts_are_dealt_once_as_numbers(spark, monkeypatch):
    """Pieces of a few words give back the rows of labelled_rows: repeated doc_ids once, null and unlabelled ones not at all."""
    monkeypatch.setattr(toxic_cnn, "PIECE", 7)
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, i % 9)) or None) for i in range(120)] + [(i, "another text") for i in range(0, 120, 7)] * 3 + [(None, "nobody")]
    docs = spark.createDataFrame(rows, PAIR).repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(5, 0), (7, None), (None, 1), (500, 1)], "doc_id long, toxic int")
    dealt = toxic_cnn._dealt(docs, labels, "toxic", 6)
    want = sorted((r["label"], len(toxic_cnn.plain_words(r["text"])), tuple(toxic_cnn.buckets_of(w)[0] for w in toxic_cnn.plain_words(r["text"]))) for r in toxic_cnn.labelled_rows(docs, labels, "toxic").collect())
    got = []
    for held in (False, True):
        batches = pa.Table.from_pylist([r.asDict() for r in dealt.filter(F.col("held") == held).collect()], dealt.limit(0).toArrow().schema).to_batches()
        index = {}
        for shard, numbered, marks, buckets, _ in toxic_cnn._pieces(batches):
            known = index[shard] = np.concatenate([index[shard], buckets]) if shard in index and not held else buckets
            got += [(int(m), len(n), tuple(known[n, 0].tolist())) for n, m in zip(numbered, marks, strict=True)]
    assert sorted(got) == want and len(want) == 101
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "text" not in plan  # what is written has no texts
