"""Near duplicates around a large cluster, against all pairs."""

import random

import pytest

from lamina.llm import simhash_dedup


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def grouped(texts, similarity=0.8):
    """The smallest number that each text reaches over pairs of this Jaccard similarity."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= similarity * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    """A group of 90 near copies, 60 texts from just above to well below the limit to it, and 50 of their own."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(300)]

    def changed(n):
        out = list(base)
        for at in rng.sample(range(300), n):
            out[at] = word()
        return " ".join(out)

    made = [changed(2) for _ in range(90)] + [changed(4 + i % 12) for i in range(60)] + [" ".join(word() for _ in range(200)) for _ in range(50)]
    rng.shuffle(made)
    return made


def test_guests_of_a_large_cluster(spark, texts, monkeypatch):
    """Texts beside the cluster are linked where some member is alike, and no others, whatever the size of a row of lanes."""
    wanted = grouped(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for lanes in (simhash_dedup.LANES, 20):
        monkeypatch.setattr(simhash_dedup, "LANES", lanes)
        found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(docs).collect()}
        assert all(wanted[found[i]] == wanted[i] for i in range(len(texts)))  # no false link
        assert sum(found[i] == wanted[i] for i in range(len(texts))) >= 0.98 * len(texts)
