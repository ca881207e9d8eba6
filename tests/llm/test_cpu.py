"""What the operators' tasks must not do again, by counting instead of timing."""

import json
import random
import sys
import unicodedata

import numpy as np
import public_tokenizers

from lamina.llm import recurrent_lm, token_counts, toxic_cnn


def some_vocabulary():
    head = [(b"w%d" % i, 9000 - i) for i in range(3000)]
    return recurrent_lm.Vocabulary(head, [b"0%d" % i for i in range(5)] + [b"11"], np.full(recurrent_lm.ENDINGS, 50.0), 10**7, 4000)


def test_training_reads_words_without_the_table_of_all_head_words():
    vocab = some_vocabulary()
    words = [b"w%d" % i for i in np.random.default_rng(1).integers(0, 6000, 5000)] + [b"", b"\xc3\xa9"]
    expected = recurrent_lm.Reader(vocab).ids(words)[0]
    reader = recurrent_lm.Reader(vocab)
    assert len(reader.named) == recurrent_lm.WORDS
    vocab.index = None
    assert reader.inputs(words).tolist() == expected.tolist()


def test_gates_lie_in_one_piece_and_states_are_those_of_the_definition():
    net, rng = recurrent_lm.Network.start(some_vocabulary()), np.random.default_rng(2)
    h, ids, u = rng.normal(size=(7, recurrent_lm.UNITS)).astype(np.float32), rng.integers(0, 1056, 7), recurrent_lm.UNITS
    new, kept = net.step(h, ids)
    assert all(part.flags.c_contiguous for part in (new, *kept))
    x, y = net.inputs[ids], h @ net.recurrent
    z, r = (1 / (1 + np.exp(-(x + y)[:, k * u : (k + 1) * u])) for k in (0, 1))
    n = np.tanh(x[:, 2 * u :] + r * y[:, 2 * u :])
    assert np.allclose(new, (1 - z) * n + z * h, atol=1e-5)


def test_known_pieces_are_not_encoded_again_and_counts_are_the_librarys(monkeypatch):
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    library, sizes = token_counts._counter(path), []
    count = token_counts._Pieces(lambda texts: sizes.append(sum(map(len, texts))) or library(texts), token_counts._added_tokens(path))
    odd = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cc", "Cf", "Mn")][:400] + [" ", "\n", "\t", "'s", "'", "7", "é", "日本", "_", "<|endoftext|>"]
    words = ["the", "of", "und", "l'eau", "x'll", "3.5", "naïve", "a" * 50, "", ""]
    texts = ["".join(rng.choice((rng.choice(odd), " ", rng.choice(words), " " + rng.choice(words))) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b ", "a  <|endoftext|>  b", "<|endoftext|>", *(f"a {c}b  {c} {c}{c} b{c} a" for c in odd)]
    for pieces in (token_counts.PIECES, 20):
        monkeypatch.setattr(token_counts, "PIECES", pieces)
        count.known, count.met = {}, set()
        for at in range(0, len(texts), 64):
            assert count(texts[at : at + 64]) == library(texts[at : at + 64])
    monkeypatch.undo()
    prose = [" ".join(rng.choice(("some", "words", "that", "repeat", "here")) for _ in range(200)) for _ in range(64)]
    count(prose), count(prose), sizes.clear()
    assert count(prose) == library(prose) and sum(sizes) < 10 * len(prose)


def test_other_tokenizers_encode_whole_texts(tmp_path):
    made = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    assert token_counts._added_tokens(public_tokenizers.path("piece_bpe_32k.model")) is None
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"pre_tokenizer": None}, {"model": {"type": "WordLevel"}}):
        (tmp_path / "t.json").write_text(json.dumps(made | change))
        assert token_counts._added_tokens(str(tmp_path / "t.json")) is None


SIZES = (0, 1, 2, 3, 5, 8, 40, 41, 90, 7)


def toxic_case():
    rng = np.random.default_rng(6)
    texts = [" ".join([*rng.choice([f"word{i}" for i in range(60)], n), *["scumbag"] * (n % 2)]) for n in SIZES]
    found, labels = toxic_cnn.Texts(texts), np.array([n % 2 for n in SIZES])
    return texts, found, labels, toxic_cnn.start_model(toxic_cnn.first_embedding(found, labels, rng), rng)


def test_training_makes_vectors_of_distinct_words_in_single_precision(monkeypatch):
    _, found, labels, model = toxic_case()
    made, vectors_of = [], toxic_cnn.vectors_of
    monkeypatch.setattr(toxic_cnn, "vectors_of", lambda *a: made.append(vectors_of(*a)) or made[-1])
    toxic_cnn.descend(model, found, labels, np.arange(len(labels)), np.ones(2), 2)
    assert {v.dtype for v in made} == {np.dtype(np.float32)}
    assert [len(v) for v in made] == [len(set(r.tolist())) for r in found.rows] * 2


def test_first_step_of_training_follows_differences_of_the_loss():
    texts, found, labels, model = toxic_case()

    def loss(places):
        p, _ = toxic_cnn.Scorer((model[0], model[1], model[2], model[3], places)).probabilities(texts)
        return -float((labels * np.log(p) + (1 - labels) * np.log(1 - p)).sum())

    before = model[4].copy()
    slope = (loss(before + np.float32(0.01)) - loss(before - np.float32(0.01))) / 0.02
    filters, embedding = [f.copy() for f in model[1]], model[0].copy()
    toxic_cnn.descend(model, found, labels, np.arange(len(labels)), np.ones(2), 1)
    assert abs(float((before - model[4])[0]) - 0.05 * slope / np.sqrt(1e-2 + slope * slope)) < 1e-3
    assert all((f != g).any() for f, g in zip(filters, model[1], strict=True)) and (embedding != model[0]).any() and not model[0][0].any()
