"""What tasks leave in the Python workers that later stages share, and how a scorer's table grows."""

import numpy as np
import public_tokenizers

from lamina.llm import bpe_codec, toxic_cnn
from lamina.llm.batches import lean

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def model():
    rng = np.random.default_rng(2)
    return toxic_cnn.start_model(toxic_cnn.log_odds(rng.integers(0, 9, (2, toxic_cnn.BUCKETS)).astype(float), np.array([9.0, 9.0]), rng), rng)


def test_a_task_drops_what_other_operators_left_in_its_worker():
    bpe_codec.codec(PATH, PATTERN)
    assert list(lean(iter, "bpe_codec")([1, 2])) == [1, 2] and len(bpe_codec._codecs) == 1
    assert list(lean(iter)([3])) == [3] and not bpe_codec._codecs


def test_a_task_gives_memory_back_also_when_it_fails(monkeypatch):
    given = []
    monkeypatch.setattr("lamina.llm.batches.give_back", lambda: given.append(1))

    def broken(batches):
        yield from batches
        raise ValueError

    try:
        list(lean(broken)([1]))
    except ValueError:
        given.append(2)
    assert given == [1, 2]


def test_scorer_fills_one_table_as_it_meets_words():
    scorer = toxic_cnn.Scorer(model())
    table = scorer.responses
    for i in range(4):
        scorer.probabilities([f"word{i} other{i} the"])
    assert scorer.responses is table and len(scorer.index) == 9


def test_scores_do_not_depend_on_what_a_scorer_remembers(monkeypatch):
    texts = [" ".join(f"w{i * k}" for i in range(k)) + " the of" for k in range(1, 40)] + ["", "der die"]
    p, language = toxic_cnn.Scorer(model()).probabilities(texts)
    monkeypatch.setattr(toxic_cnn, "REMEMBERED", 3)
    scorer = toxic_cnn.Scorer(model())
    for a, b, text in zip(p, language, texts, strict=True):  # grows beyond its room, forgets, and starts anew
        q, other = scorer.probabilities([text])
        assert abs(q[0] - a) < 1e-6 and other[0] == b
