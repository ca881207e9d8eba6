"""The corpus operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lamina.llm import bpe_codec, decontaminate, knn_quality, label_shards, prefix_hash, recurrent_lm, simhash_dedup, token_counts, toxic_cnn, url_lists

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score string"


def odd_texts():
    rng = random.Random(5)
    words = ["the", "of", "naïve", "漢字", "🙂", "x", "Word", "end.", "a\tb", " ", "straße"]
    texts = [None, "", " ", "one", "two words", "\n\n\n", "a b c d", "a b c d", "word " * 3000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    return texts + texts[-6:]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, very long and repeated texts, and extra columns whose names the operators use themselves."""
    rows = [(i, t, None, "s", None, "clash", "clash") for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(frame):
    return {r["doc_id"]: r["text"] or "" for r in frame.collect()}


def test_codec_is_tiktoken_and_round_trips(docs, empty):
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe_codec.read_ranks(PATH), special_tokens={})
    found = bpe_codec.decode(bpe_codec.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    texts = texts_of(docs)
    assert len(found) == len(texts)
    for r in found:
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode() and r["n_tokens"] == len(r["ids"]) // 4
    assert bpe_codec.encode(empty, PATH, PATTERN).count() == 0


def test_offsets_cover_the_text_and_split_characters_come_together(spark):
    text = "naïve 漢🙂 end"
    row = bpe_codec.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, PATTERN, with_offsets=True).first()
    spans = list(zip(row["offsets"][::2], row["offsets"][1::2], strict=True))
    assert {i for a, b in spans for i in range(a, b)} == set(range(len(text)))
    _, by_id = bpe_codec.codec(PATH, PATTERN)
    pieces = [by_id[i] for i in np.frombuffer(row["ids"], "<u4")]
    assert "".join(bpe_codec.decode_stream(pieces)) == text


def test_token_counts_use_and_fill_the_cache(spark, docs, empty, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    count = token_counts._counter(path)
    texts = texts_of(docs)
    for _ in range(2):  # the second run finds every text in the cache
        found = {r["doc_id"]: r for r in token_counts.count_tokens(docs, cache, path).collect()}
        assert {k: r["n_tokens"] for k, r in found.items()} == dict(zip(texts, count(list(texts.values())), strict=True))
        assert {k: r["n_bytes"] for k, r in found.items()} == {k: len(t.encode()) for k, t in texts.items()}
        assert spark.read.parquet(cache).count() == len(set(texts.values()))
    # What the cache says is taken: the second run did not encode anew.
    version = token_counts.tokenizer_version(path)
    spark.createDataFrame([(bytearray(hashlib.sha256(b"planted").digest()), version, 77)], token_counts.CACHE_SCHEMA).write.mode("append").partitionBy("version").parquet(cache)
    assert token_counts.count_tokens(spark.createDataFrame([(1, "planted")], "doc_id long, text string"), cache, path).first()["n_tokens"] == 77
    assert token_counts.count_tokens(empty, cache, path).count() == 0


def test_sentence_pieces_count_too(spark, tmp_path):
    rows = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(rows, str(tmp_path / "c"), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got[1] > 0 and got[2] == 0


def test_fingerprints_follow_the_order_of_documents(spark, docs, empty):
    found = {r["doc_id"]: r for r in prefix_hash.fingerprint_documents(docs).collect()}
    texts = texts_of(docs)
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        after = texts[order[(i + 1) % len(order)]]
        text = prefix_hash.edited(texts[k], after)
        assert found[k]["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert found[k]["edited_fingerprint"] == prefix_hash.fingerprint(prefix_hash.PrefixHashes(text))
        assert found[k]["n_chars"] == len(texts[k])
        assert 0 <= found[k]["near_next"] <= 1 and (found[k]["near_next"] == 1) == (after == texts[k])
    by_text = collections.defaultdict(set)
    for k, r in found.items():
        by_text[texts[k]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({f for v in by_text.values() for f in v}) == len(by_text)
    assert prefix_hash.fingerprint_documents(empty).count() == 0
    single = prefix_hash.fingerprint_documents(spark.createDataFrame([(None, "alone")], "doc_id long, text string")).first()
    assert single["near_next"] == 1 and single["edited_sha256"] == hashlib.sha256(b"aloal").hexdigest()


def test_span_equality_and_common_extensions():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 90))) for _ in "ab")
        x, y = prefix_hash.PrefixHashes(a), prefix_hash.PrefixHashes(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert prefix_hash.common_extension(x, i, y, j) == n


def plain_fingerprint(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_of(prints, radius):
    keys, parent = list(prints), {k: k for k in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in keys}


def test_simhash_matches_its_definition(spark, docs, empty):
    found = {r["doc_id"]: r for r in simhash_dedup.near_duplicates(docs).collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts_of(docs).items()}
    assert {k: r["fp"] & (2**64 - 1) for k, r in found.items()} == prints
    assert {k: r["component_id"] for k, r in found.items()} == components_of(prints, 4)
    assert simhash_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_links_of_crowded_fingerprints_are_all_found(spark, radius, monkeypatch):
    """A dense cloud, chains and strangers: components as by comparing all pairs, with every table entry crowded."""
    monkeypatch.setattr(simhash_dedup, "CROWDED", 3)
    rng = random.Random(radius)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(40)}
    for _ in range(8):
        x = rng.getrandbits(64)
        prints |= {x := x ^ sum(1 << b for b in rng.sample(range(64), radius)) for _ in range(4)}
    signed = {i: p for i, p in enumerate(sorted(prints))}
    known = spark.createDataFrame([(p - (1 << 64) * (p >> 63),) for p in signed.values()], "fp long")
    dense = simhash_dedup.connected_components(simhash_dedup.dense_links(known, radius))
    joined = known.join(dense.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    far = simhash_dedup.far_links(joined, [("fp", *part) for part in simhash_dedup.segment_plan(known.count(), radius)], radius)
    edges = {(r["u"], r["v"]) for r in far.collect()} | {(r["fp"], r["component"]) for r in joined.collect()}
    parent = {p - (1 << 64) * (p >> 63): p - (1 << 64) * (p >> 63) for p in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for u, v in edges:
        parent[root(u)] = root(v)
    groups = collections.defaultdict(set)
    for k in parent:
        groups[root(k)].add(k & (2**64 - 1))
    expected = collections.defaultdict(set)
    for i, c in components_of(signed, radius).items():
        expected[c].add(signed[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_shards_are_even_and_keep_copies_together(spark, docs, empty):
    rows = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "hot", None, None, None, None, None)] * 70, SCHEMA))
    found = label_shards.shard_documents(rows, shards=6).collect()
    sizes = collections.Counter(r["shard"] for r in found)
    assert len(found) == rows.count() and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(6))
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n))
    texts = texts_of(docs)
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in found if r["doc_id"] is not None)
    shards_of = collections.defaultdict(set)
    for r in found:
        shards_of[r["text_crc32"], r["size"]].add(r["shard"])
    assert sum(len(v) > 1 for v in shards_of.values()) <= 6  # the hot text must be cut, and the cut may cost a few others
    assert label_shards.shard_documents(empty, shards=6).count() == 0
    assert {r["shard"] for r in label_shards.shard_documents(rows.limit(2), shards=6).collect()} <= set(range(6))


def labelled(spark, n=240):
    rng = random.Random(4)
    words = ["river", "stone", "morning", "walked", "under", "bright", "the", "and", "of", "a", "quiet", "garden"]
    rows, marks = [], []
    for i in range(n):
        good = [rng.choice(words) for _ in range(rng.randint(30, 60))]
        bad = i % 4 == 0
        toxic = i % 3 == 0
        if toxic:
            good[rng.randrange(len(good))] = "scumbag"
        rows.append((i, " ".join(w + "$$%" if bad else w for w in good)))
        marks.append((i, int(not bad), int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "river")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1, 1), (n + 9, None, None)], "doc_id long, quality int, toxic int")


def test_quality_votes_hold_out(spark, empty):
    docs, labels = labelled(spark)
    held = knn_quality.crc_remainder("doc_id", 3) == 1
    found = {r["doc_id"]: r for r in knn_quality.score_quality(docs, labels.filter(~held)).collect()}
    truth = [(r["doc_id"], r["quality"]) for r in labels.filter(held & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).collect()]
    assert np.mean([found[k]["predicted"] == q for k, q in truth]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[240]["score"] == found[241]["score"]
    assert knn_quality.score_quality(docs, labels.limit(0)).filter("score = 0.5").count() == docs.count()
    assert knn_quality.score_quality(empty.select("doc_id", "text"), labels).count() == 0


def test_votes_match_all_comparisons():
    rng = np.random.default_rng(1)
    known, labels, x = knn_quality.unit(rng.normal(size=(50, 8))), rng.integers(0, 2, 50), knn_quality.unit(rng.normal(size=(9, 8)))
    got = knn_quality.vote(x, known, labels, 0.5, np.ones(2), k=5)
    for row, score in zip(x, got, strict=True):
        near = sorted(((float(row @ k), int(y)) for k, y in zip(known, labels, strict=True)), reverse=True)[:5]
        weights = [max(0, s) ** 8 for s, _ in near]
        assert math.isclose(score, sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights))


def test_toxic_words_are_learned_and_harmless_texts_left_alone(spark, empty):
    docs, labels = labelled(spark)
    held = knn_quality.crc_remainder("doc_id", 5) == 0
    found = {r["doc_id"]: r for r in toxic_cnn.score_toxicity(docs, labels.filter(~held)).collect()}
    truth = [(r["doc_id"], r["toxic"]) for r in labels.filter(held & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).collect()]
    assert np.mean([found[k]["predicted"] == t for k, t in truth]) > 0.95
    assert found[240]["predicted"] == found[241]["predicted"] == 0
    assert toxic_cnn.score_toxicity(docs, labels.limit(0)).filter("score = 0").count() == docs.count()
    assert toxic_cnn.score_toxicity(empty.select("doc_id", "text"), labels).count() == 0


def test_word_far_into_a_very_long_text_counts(spark):
    docs, labels = labelled(spark)
    model, _ = toxic_cnn.fit(*_sample(docs, labels), 0.3)
    long = "river stone " * 70_000
    p, _ = toxic_cnn.Scorer(model).probabilities([long, long + "scumbag", "scumbag " + long])
    assert p[0] < 0.5 < min(p[1], p[2])


def _sample(docs, labels):
    rows = docs.join(labels, "doc_id").filter("toxic is not null and text is not null").orderBy("doc_id").collect()
    return [r["text"] for r in rows], np.array([r["toxic"] for r in rows])


def test_thresholds_cut_between_the_classes():
    p, y = np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([0, 0, 0, 1, 1])
    assert math.isclose(toxic_cnn.threshold(p, y, np.ones(2)), 0.55)
    assert np.allclose(toxic_cnn.bent(np.array([0.0, 0.2, 1.0]), np.array([0.2] * 3)), [0, 0.5, 1])


def test_edited_benchmark_items_are_found(spark, empty):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = [[rng.choice(words) for _ in range(rng.randint(20, 50))] for _ in range(12)] + [["too", "short"]]
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None)], "item_id long, text string")
    noise = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for i, item in enumerate(items[:12]):
        edited = [w if rng.random() > 0.1 else rng.choice(words) for w in item]
        rows.append((i, " ".join(noise(80) + [w.upper() + "," for w in edited] + noise(80)), "x"))
    rows += [(100 + i, " ".join(noise(300)), "x") for i in range(20)] + [(200, None, "x"), (201, "", "x"), (202, "too short", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    found = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(12)} | {(202, 12)}
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(empty, benchmark).count() == 0


@pytest.mark.parametrize("step", [6, 8])
def test_edited_copies_are_found_beside_exact_ones(spark, step):
    """Exact copies make the n-grams that an edit broke the rarest of their block; the edited copy holds none of those."""
    rng = random.Random(step)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(48))) for i in range(20)]
    rows = [(i, t) for i, t in items] + [(100 + i, t) for i, t in items]
    for i, t in items:
        rows.append((200 + i, " ".join("edit" if k % step == step - 1 else w for k, w in enumerate(t.split()))))
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(i + shift, i) for i, _ in items for shift in (0, 100, 200)}


def test_alignment_scores_match_the_full_table():
    rng = random.Random(3)
    for _ in range(40):
        a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randint(1, 15))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
        assert decontaminate.align(a, b)[0] == max(map(max, table))


def test_without_the_sorted_hashes_the_result_is_the_same(spark, monkeypatch):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so alpha beta gamma delta epsilon zeta eta theta ends"), (2, "nothing of it here at all")], "doc_id long, text string")
    full = decontaminate.contaminated(docs, benchmark).collect()
    monkeypatch.setattr(decontaminate, "SENT", 0)
    assert decontaminate.contaminated(docs, benchmark).collect() == full and len(full) == 1


def test_lists_are_read_as_of_the_fetch(spark):
    entries = [("l", "example.com", "block", "2024-01-05"), ("l", "example.com", "remove", "2024-02-01"), ("l", "ok.example.com", "allow", "2024-01-01"), ("m", "b.org", "block", "2024-01-10"), ("m", None, "block", "2024-01-01")]
    captures = [(1, "http://a.example.com/x", "2024-01-04"), (2, "http://a.example.com:80/x", "2024-01-05"), (3, "https://u@A.example.com?q", "2024-02-01"), (4, "http://ok.example.com", "2024-01-20"), (5, "http://xb.org", "2024-03-01"),
                (6, "http://b.org#f", "2024-03-01"), (7, None, "2024-03-01"), (8, "http://b.org", None), (6, "http://b.org#f", "2024-03-01")]
    log = spark.createDataFrame(entries, "list string, pattern string, action string, dated string").withColumn("dated", F.col("dated").cast("date"))
    seen = spark.createDataFrame(captures, "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date")).withColumn("list", F.lit("clash"))
    got = sorted((r["page_id"], r["blocked"], r["lists"]) for r in url_lists.evaluate(seen, log).collect())
    assert got == [(1, False, ""), (2, True, "l"), (3, False, ""), (4, False, ""), (5, False, ""), (6, True, "m"), (6, True, "m"), (7, False, ""), (8, False, "")]
    assert url_lists.evaluate(seen.limit(0), log).count() == 0 and url_lists.evaluate(seen, log.limit(0)).filter("blocked").count() == 0


def test_language_model_counts_and_scores(spark, docs, empty, tmp_path):
    held = knn_quality.crc_remainder("doc_id", 10) == 0
    found = {r["doc_id"]: r for r in recurrent_lm.score_documents(docs, held, str(tmp_path / "lm")).collect()}
    texts = texts_of(docs)
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] + [None]
    counts = collections.Counter(w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 10 for w in split(t))
    total, distinct = sum(counts.values()), len(counts)
    for k, r in found.items():
        words = split(texts[k])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["n_tokens"] == len(words)
        assert r["n_known"] == sum(counts[w] > 0 for w in words) and r["train_tokens"] == total
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 10 == 0) and r["score"] < 0
    assert recurrent_lm.score_documents(empty, held, str(tmp_path / "none")).count() == 0


def small_vocabulary():
    head = [(b"w%d" % i, 100 - i) for i in range(40)]
    return recurrent_lm.Vocabulary(head, [b"ab"], np.ones(recurrent_lm.ENDINGS), 5000, 60)


def test_network_is_a_distribution_and_learns():
    vocab = small_vocabulary()
    vocab.named, vocab.classes = 40, 2
    net = recurrent_lm.Network.start(vocab)
    h = np.random.default_rng(1).normal(size=(3, recurrent_lm.UNITS)).astype(np.float32)
    names = np.arange(40 + recurrent_lm.ENDINGS)
    for row in h:
        logp, _ = net.outputs(np.repeat(row[None], len(names), 0), names)
        assert abs(np.exp(logp).sum() - 1) < 1e-4
    ids = np.tile(np.arange(10, dtype=np.int32), 4000)  # each word tells the next
    keep = np.ones(len(ids), np.float32)
    recurrent_lm.train_part(net, ids, 16, keep)
    score = recurrent_lm.score_streams(net, [ids[:200]])[0] / 200
    assert score > -0.7, score


def test_gradients_match_differences():
    vocab = small_vocabulary()
    vocab.named, vocab.classes = 40, 2
    net = recurrent_lm.Network.start(vocab)
    rng = np.random.default_rng(2)
    for name in net.NAMES:
        value = getattr(net, name)
        setattr(net, name, (value + rng.normal(0, 0.1, value.shape)).astype(np.float64))
    ids, keep = rng.integers(0, 60, (4, 5)).astype(np.int32), np.ones((4, 5))
    keep[2, 1] = 0
    told = np.ones((4, 5), bool)
    told[3, 4] = False
    trainer, seen = recurrent_lm.Trainer(net), []
    trainer.descend = lambda grads, targets: seen.append(grads)
    trainer.window(np.zeros((5, recurrent_lm.UNITS)), ids, keep, told)

    def loss():
        h, total = np.zeros((5, recurrent_lm.UNITS)), 0.0
        for t in range(4):
            h = h * keep[t][:, None]
            total -= net.outputs(h, ids[t])[0][told[t]].sum()
            h, _ = net.step(h, ids[t])
        return total

    for name, grad in zip(net.NAMES, seen[0], strict=True):
        value = getattr(net, name)
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in value.shape)
            old = value[i]
            value[i] = old + 1e-5
            up = loss()
            value[i] = old - 1e-5
            down = loss()
            value[i] = old
            assert abs((up - down) / 2e-5 - grad[i]) < 2e-3 * max(1, abs(grad[i])), (name, i)


def test_state_runs_through_whole_texts_and_packing_changes_nothing():
    vocab = small_vocabulary()
    vocab.named, vocab.classes = 40, 2
    net = recurrent_lm.Network.start(vocab)
    rng = np.random.default_rng(3)
    net.out = rng.normal(0, 0.5, net.out.shape).astype(np.float32)
    texts = [rng.integers(0, 60, n).astype(np.int32) for n in (1, 700, 3, 40, 40, 1, 9)]
    together = recurrent_lm.score_streams(net, texts)
    alone = [recurrent_lm.score_streams(net, [t])[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-4)
