"""The pipeline's stages on a planted corpus: what must go goes, clean documents stay."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lamina.llm import bpe_codec, simhash_dedup

WORDS = [a + b for a in ("ri", "sto", "mor", "wal", "un", "bri", "qui", "gar") for b in ("ver", "ne", "ning", "ked", "der", "ght", "et", "den", "lo", "sa")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def planted(spark, folder):
    rng = random.Random(12)
    rows, labels, toxic, low = [], [], set(), set()
    for i in range(300):
        words = text(rng, rng.randint(60, 120)).split()
        if i % 10 == 1:
            words[rng.randrange(len(words))] = "scumbag"
            toxic.add(i)
        if i % 10 == 2:
            words = [w + "$$%" for w in words]
            low.add(i)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(i not in low), int(i in toxic)))
    clean = [r for r in rows if r[0] not in toxic | low]
    rows += [(1000 + k, clean[k][1], "fr", "t", 1) for k in range(5)]  # exact copies
    near = [clean[k + 10][1].split() for k in range(5)]
    for k, words in enumerate(near):
        words[len(words) // 2] = "changed"
        rows.append((1100 + k, " ".join(words), "en", "s", 2))
    items = [(k, text(rng, 30)) for k in range(4)]
    rows += [(1200 + k, text(rng, 40) + " " + t.upper() + " " + text(rng, 40), "en", "s", 3) for k, t in items]
    rows += [rows[5]]  # a repeated row
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {r[0]: r[1] for r in rows}, {r[0] for r in clean}


def test_pipeline_keeps_what_is_clean(spark, tmp_path):
    texts, clean = planted(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r["doc_id"] for r in out]
    assert len(kept) == len(set(kept)) and clean == set(kept)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe_codec.read_ranks(path), special_tokens={})
    for r in out:
        assert r["round_trip"] and np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(texts[r["doc_id"]])


def test_every_stage_but_the_last_returns_the_documents_columns(spark, tmp_path):
    planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == list(corpus_pipeline.COLUMNS)


def test_similar_documents_are_found_by_share_of_shingles(spark):
    rng = random.Random(3)
    rows, pairs = [], []
    for i in range(60):
        words = text(rng, 200).split()
        rows.append((2 * i, " ".join(words)))
        for _ in range(i % 3 + 1):  # each changed word touches five shingles
            words[rng.randrange(len(words))] = f"other{rng.random()}"
        rows.append((2 * i + 1, " ".join(words)))
        pairs.append((2 * i, 2 * i + 1))
    rows += [(500 + k, t) for k, t in enumerate([None, "", " ", "short", "short"])]
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([found[a] == found[b] for a, b in pairs]) > 0.95
    assert len({found[a] for a, _ in pairs}) == len(pairs)
    assert found[500] == found[501] == found[502] == 500 and found[503] == found[504] == 503
    assert simhash_dedup.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def edited_pairs(spark, n, changes):
    """n pairs of 200 words with as many isolated changes, each of which breaks five shingles."""
    rng, rows = random.Random(9), []
    for i in range(n):
        words = text(rng, 200).split()
        rows.append((2 * i, " ".join(words)))
        for at in rng.sample(range(10, 190, 10), changes):
            words[at] = f"other{rng.random()}"
        rows.append((2 * i + 1, " ".join(words)))
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return np.mean([found[2 * i] == found[2 * i + 1] for i in range(n)])


def test_pairs_close_to_the_limit_are_mostly_found(spark):
    share = edited_pairs(spark, 400, 4)  # 176 of 216 shingles
    assert share > 0.95, share


@pytest.mark.parametrize("held", [1 << 25, 0])
def test_pairs_below_the_limit_are_never_linked(spark, held, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "HELD", held, raising=False)
    assert edited_pairs(spark, 400, 5) == 0  # 171 of 221 shingles
