"""Repeated byte strings, source divergences and filter audits against brute force, on small tables with odd rows."""

import collections
import hashlib
import itertools
import random
import re

import pytest

from lamina.llm import filter_audit, source_divergence, suffix_merge

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, shard long, part string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None, "clash", 1, "clash", 2) for i, t, lang, source in rows], SCHEMA).repartition(3)


def cut_by_brute_force(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    counts = collections.Counter(x[j : j + length] for _, x in texts for j in range(len(x) - length + 1))
    out = []
    for i, x in texts:
        gone = [False] * len(x)
        for j in range(len(x) - length + 1):
            if counts[x[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def prose(rng, n, letters="abcdefgh é漢 "):
    return "".join(rng.choice(letters) for _ in range(n))


def repeated_rows(rng):
    """Passages around the limit, at all ends of texts, overlapping, periodic, nested, in very few letters, and copies."""
    passages = [prose(rng, n) for n in (180, 300, 330, 360, 400, 450, 700)]
    texts = [None, "", "short", "a" * 399, "b" * 400, "c" * 401, "ab" * 900, "x" * 3000, prose(rng, 2500)]
    for _ in range(40):
        parts = [prose(rng, rng.choice((0, 1, 5, 60, 300))), rng.choice(passages), prose(rng, rng.choice((0, 1, 30, 500)))]
        parts.insert(rng.randrange(4), rng.choice(passages)[rng.randrange(40) :])
        texts.append("".join(parts))
    whole = prose(rng, 3000)
    texts += [whole, whole, whole[:1500] + "edited" + whole[1500:], whole[200:], whole[:-200], whole[700:1100] + prose(rng, 30), whole + whole[:500]]
    texts += [prose(rng, 900, "ab"), "".join(prose(rng, 20, "ab") * 30)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return [*rows, (None, whole[100:900], None, None), (3, texts[12], "de", None)]


@pytest.mark.parametrize("shard_bytes, length", [(4 << 20, 400), (5_000, 400), (3_000, 256)])
def test_repeated_strings_are_those_of_brute_force(spark, monkeypatch, shard_bytes, length):
    monkeypatch.setattr(suffix_merge, "SHARD_BYTES", shard_bytes)
    rows = repeated_rows(random.Random(length + shard_bytes))
    found = suffix_merge.without_repeats(frame(spark, rows), length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r) for r in found.collect()), key=str) == cut_by_brute_force(rows, length)


def test_a_passage_in_very_many_texts_asks_for_one_row_a_shard(spark):
    rng = random.Random(3)
    passage = prose(rng, 600, "abcdefghijkl ")
    rows = [(i, prose(rng, 200, "mnopqrs ") + passage + prose(rng, 200, "mnopqrs "), "en", "s") for i in range(400)]
    merge = suffix_merge.Merge(frame(spark, rows), 400)
    shards = merge.shards.count()
    twice = merge.symbols().groupBy("digest").count()
    assert twice.agg({"count": "max"}).first()[0] <= shards
    found = suffix_merge.without_repeats(frame(spark, rows)).collect()
    assert all(r["n_removed"] >= len(passage) for r in found) and len(found) == 400


def test_no_rows_and_too_short_strings(spark):
    assert suffix_merge.without_repeats(frame(spark, [])).count() == 0
    assert source_divergence.divergence_audit(frame(spark, [])).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(frame(spark, []), labels).count() == 0
    with pytest.raises(ValueError):
        suffix_merge.Merge(frame(spark, []), 100)


def audited_by_brute_force(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, lang, _ in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed_by, steps = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for n, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                removed_by[f] += len(gone)
                redundant = sum(d[1][f] for d in own) - len(gone)
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                steps.append((f, part, "".join(order), n, len(left), len(gone), redundant, only, sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*s[1:], removed_by[s[0]]) for s in steps]
    return sorted(out)


def test_every_order_of_the_filters(spark):
    rng = random.Random(1)
    bits = ["word", "WORD", "a#b", "naïve", "漢字", "\t", "\x0b", " ", "50%"]
    texts = [None, "", " \n"] + [" ".join(rng.choice(bits) + str(rng.randrange(k)) for _ in range(n)) for n in (5, 99, 100, 101, 400) for k in (1, 30, 3000)]
    rows = [(i, rng.choice(texts), rng.choice(("en", "de", None, "")), "s") for i in range(150)]
    rows += [(None, texts[5], "en", "s"), (None, texts[5], "de", "s"), (7, texts[5], "en", "s"), (7, texts[5], "fr", "s"), rows[0]]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 150, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    found = filter_audit.audit_filters(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in found.collect()) == audited_by_brute_force(rows, labels)


def diverging_by_brute_force(rows, least, most):
    counts, documents, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    lower = {i: i + 32 for i in range(65, 91)}
    for _, text, lang, source in rows:
        terms = [x.translate(lower) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        group = (lang or "", source or "")
        groups.add(group)
        counts[group].update(terms)
        documents[group[0]].update(set(terms))
    share = lambda n, total, v: 1 + 10**9 * (n + 1) // (total + v)
    value = lambda p, q: (p - q) ** 2 // q
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        own = [g for g in groups if g[0] == lang]
        p = {g: {t: share(counts[g][t], sum(counts[g][x] for x in kept), len(kept)) for t in kept} for g in own}
        whole = sum(counts[g][t] for g in own for t in kept)
        q = {t: share(sum(counts[g][t] for g in own), whole, len(kept)) for t in kept}
        for g in own:
            pairs = sorted((-sum(value(p[g][t], p[h][t]) for t in kept), h[1].encode(), h[1]) for h in own if h != g)
            terms = sorted((-value(p[g][t], q[t]), t.encode(), t) for t in kept if counts[g][t] and p[g][t] > q[t])[:most]
            out += [(*g, "pair", item, -v, i) for i, (v, _, item) in enumerate(pairs, 1)]
            out += [(*g, "term", item, -v, i) for i, (v, _, item) in enumerate(terms, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, columns, chunk, held", [(64, 8192, 400_000, 400_000), (3, 7, 60, 40)])
def test_divergences_of_all_pairs(spark, monkeypatch, block, columns, chunk, held):
    for name, v in (("BLOCK", block), ("COLUMNS", columns), ("CHUNK_ROWS", chunk), ("HELD", held)):
        monkeypatch.setattr(source_divergence, name, v)
    rng = random.Random(2)
    terms = [prose(rng, rng.randint(1, 5), "abéZ漢") for _ in range(80)]
    rows = [(i, " ".join(rng.choices(terms, k=rng.randint(0, 40))) + rng.choice(("", "-x9Y_", "\x00É")), rng.choice(("en", None)), f"s{min(int(rng.expovariate(0.3)), 9)}") for i in range(200)]
    rows += [(900, None, "fr", "a"), (901, "alone", "fr", "b"), (902, "alone", "fr", None), (903, "x " * 5000, "de", "one"), rows[5], rows[5]]
    found = source_divergence.divergence_audit(frame(spark, rows), 3, 12)
    assert sorted(tuple(r) for r in found.collect()) == diverging_by_brute_force(rows, 3, 12)


def test_shares_are_exact_for_very_large_counts():
    import numpy as np

    counts, total = np.array([[0, 10**12, 8 * 10**15]]), np.array([8 * 10**15 + 7])
    assert source_divergence.shares(counts, total).tolist() == [[1 + 10**9 * (int(c) + 1) // int(total[0]) for c in counts[0]]]
