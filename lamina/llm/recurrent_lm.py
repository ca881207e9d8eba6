"""Language-model scores of documents by a gated recurrent network with a class-factored softmax.

Words are bytes without white space, ASCII letters in lower case; a text ends with an end
token. Corpus counts come first: every training word is counted on Spark, and all later
steps take their probabilities from these counts. The WORDS most frequent words are
outputs of their own, in classes of CLASS words by rank. Every other word belongs to one
of ENDINGS classes by its last bytes, within which it has its smoothed relative
frequency. A word's probability is that of its class times that within the class; both
softmaxes read the network's state, so each output costs classes plus class members
instead of the vocabulary. Words that training never saw count, in each ending class, as
one more word with the smoothing mass, as in the base.

Training runs in rounds: each task trains a copy on all its training texts of the round by
truncated backpropagation (windows of WINDOW tokens, states carried from window to
window), and the copies' weighted mean starts the next round. Each training text is read
in one round. Scoring carries the state from a text's first token to its last.

Counts of words outside the HEAD most frequent ones are never sent to all tasks: their
part of each text is joined by word on Spark.

Defined results: a null text counts as empty (one end token); repeated texts are scored
alike; without training texts every count is 0, the network keeps its start values and
base is the smoothed estimate of an empty corpus. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lamina.llm.batches import small_batches

#: Words with outputs of their own, words of a class, classes of all other words.
WORDS, CLASS, ENDINGS = 1024, 32, 32
#: Units of the state, tokens of a window, windows' rows at most, rounds of training.
UNITS, WINDOW, ROWS, ROUNDS = 16, 16, 256, 3
#: Words whose counts every task holds, at most.
HEAD = 1 << 17
#: Tokens that a task scores at once, rows that it advances together.
TOKENS_AT_ONCE, STREAMS = 2_000_000, 512
SMOOTHING, RATE = 0.1, 0.01
END = b""


def tokens(text: str) -> list[bytes]:
    """Words of a text and the end token. Bytes know ASCII case and white space only."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


# Corpus counts.


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])
        found.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            found.update(tokens(text.as_py()))
        if len(found) > 200_000:
            yield flush()
    if found:
        yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all given texts; every task sums up before the shuffle."""
    return small_batches(texts).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What every task knows of the words; bounded by HEAD whatever the corpus."""

    def __init__(self, head: list[tuple[bytes, int]], endings: list[bytes], masses: np.ndarray, total: int, distinct: int):
        self.total, self.distinct, self.masses = total, distinct, masses
        self.endings = {e: i for i, e in enumerate(endings)}
        self.index = {w: i for i, (w, _) in enumerate(head)}
        self.counts = np.array([n for _, n in head], np.float64)
        self.named = min(WORDS, len(head))
        self.classes = -(-self.named // CLASS)
        # Of each head word: its id as an input, and whether its count is known here.
        self.ids = np.array([i if i < self.named else self.named + self.ending(w) for i, (w, _) in enumerate(head)], np.int32)

    def ending(self, word: bytes) -> int:
        return self.endings.get(word[-2:], ENDINGS - 1)

    @property
    def base_norm(self) -> float:
        return self.total + SMOOTHING * (self.distinct + 1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head words, the endings' classes and their masses; collects HEAD words and a row for each ending at most."""
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    size = F.floor(F.log2("n") * 16).cast("int")
    bins = sorted(((r["size"], r["words"]) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect()), reverse=True)
    room, least = HEAD, None
    for at, words in bins:
        if words > room:
            break
        room, least = room - words, at
    head = counts.filter(size >= least).collect() if least is not None else []
    head = sorted(((bytes(r["word"]), r["n"]) for r in head), key=lambda x: (-x[1], x[0]))
    named = counts.sparkSession.createDataFrame([(bytearray(w),) for w, _ in head[:WORDS]] or [(bytearray(b"\0"),)], "word binary")
    others = counts.join(F.broadcast(named), "word", "left_anti")  # WORDS rows
    ending = F.substring("word", -2, 2).alias("ending")
    masses = others.groupBy(ending).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()  # two bytes: 65,536 rows at most
    masses = sorted(((bytes(r["ending"]), r["n"], r["words"]) for r in masses), key=lambda x: (-x[1], x[0]))
    top = masses[: ENDINGS - 1]
    rest = masses[ENDINGS - 1 :]
    sums = [(n, words) for _, n, words in top] + [(0, 0)] * (ENDINGS - 1 - len(top)) + [(sum(x[1] for x in rest), sum(x[2] for x in rest))]
    return Vocabulary(head, [e for e, _, _ in top], np.array([n + SMOOTHING * words + SMOOTHING for n, words in sums]), total or 0, distinct)


# The network.


class Network:
    """Parameters and steps of the recurrent network."""

    NAMES = ("inputs", "recurrent", "out", "out_bias", "inner", "inner_bias")

    def __init__(self, words: int, classes: int, values: dict[str, np.ndarray]):
        self.words, self.classes = words, classes  # named words, and their classes
        self.__dict__.update(values)

    @classmethod
    def start(cls, vocab: Vocabulary) -> Network:
        """The class-factored unigram model: states don't speak yet."""
        rng = np.random.default_rng(11)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        inner = np.zeros((max(1, vocab.classes), CLASS))
        inner.reshape(-1)[: vocab.named] = vocab.counts[: vocab.named] + SMOOTHING
        mass = np.concatenate((inner.sum(1)[: vocab.classes], vocab.masses))
        inner_bias = np.where(inner > 0, np.log(np.maximum(inner, 1e-9)), -30.0)
        return cls(vocab.named, vocab.classes, {
            "inputs": normal(vocab.named + ENDINGS, 3 * UNITS, scale=0.3),
            "recurrent": normal(UNITS, 3 * UNITS, scale=0.3),
            "out": np.zeros((UNITS, vocab.classes + ENDINGS), np.float32),
            "out_bias": np.log(mass / mass.sum()).astype(np.float32),
            "inner": np.zeros((max(1, vocab.classes), UNITS, CLASS), np.float32),
            "inner_bias": (inner_bias - np.log(np.maximum(inner.sum(1, keepdims=True), 1e-9))).astype(np.float32),
        })

    def values(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in self.NAMES]

    def packed(self) -> bytes:
        return np.concatenate([v.reshape(-1) for v in self.values()]).astype(np.float64).tobytes()

    def unpacked(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for name, value in zip(self.NAMES, self.values(), strict=True):
            out[name] = flat[at : at + value.size].reshape(value.shape).astype(np.float32)
            at += value.size
        return Network(self.words, self.classes, out)

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (3, words, UNITS) and recurrent weights (3, UNITS, UNITS) by gate, those of z and r with the other sign: what ``advance`` reads."""
        by_gate = [np.ascontiguousarray(p.reshape(-1, 3, UNITS).transpose(1, 0, 2)) for p in (self.inputs, self.recurrent)]
        for p in by_gate:
            np.negative(p[:2], out=p[:2])
        return by_gate[0], by_gate[1]

    @staticmethod
    def advance(h: np.ndarray, x: np.ndarray, recurrent: np.ndarray) -> tuple:
        """The state after inputs x (3, rows, UNITS), and what the way back needs. Each gate lies in one piece, as numpy is slow on parts of rows."""
        u = np.matmul(h, recurrent)
        gates = x[:2] + u[:2]
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r, un = gates[0], gates[1], u[2]
        n = r * un
        n += x[2]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, (z, r, un, n)

    def step(self, h: np.ndarray, ids: np.ndarray) -> tuple:
        """The state after reading ids, and what the way back needs."""
        inputs, recurrent = self.blocks()
        return self.advance(h, inputs.take(ids, 1), recurrent)

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.words, ids // CLASS, ids - self.words + self.classes).astype(np.int16)

    def outputs(self, h: np.ndarray, ids: np.ndarray, grads: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each id's class and, for named words, of the word in it; with ``grads`` also the states' gradients of the loss.

        Biases are one more row of the weights. The tables of rows by classes stay sums of exponentials; what divides a row goes into its few states.
        """
        classes, rows = self.classes_of(ids), np.arange(len(ids))
        h = np.concatenate((h, np.ones((len(h), 1), h.dtype)), 1)
        logits = h @ np.concatenate((self.out, self.out_bias[None]))
        logp = logits[rows, classes]
        np.exp(logits, out=logits)
        mass = logits @ np.ones(logits.shape[1], h.dtype)
        logp -= np.log(mass)
        back = None
        if grads is not None:
            logits[rows, classes] -= mass
            share = (1 / mass)[:, None]
            back = logits @ self.out.T
            back *= share
            more = (h * share).T @ logits
            grads[2] += more[:UNITS]
            grads[3] += more[UNITS]
        # Rows of one class together: a product for each class, all else at once.
        order = np.argsort(classes, kind="stable")
        bounds = np.searchsorted(classes.take(order), np.arange(self.classes + 1)).tolist()
        order = order[: bounds[-1]]
        if not len(order):
            return logp, back
        states, inner = h.take(order, 0), np.empty((len(order), CLASS), h.dtype)
        filled = [(c, slice(bounds[c], bounds[c + 1])) for c in range(self.classes) if bounds[c] < bounds[c + 1]]
        weights = np.concatenate((self.inner, self.inner_bias[:, None]), 1)
        for c, own in filled:
            np.matmul(states[own], weights[c], out=inner[own])
        rows, member = rows[: len(order)], ids.take(order) % CLASS
        chosen = inner[rows, member]
        np.exp(inner, out=inner)
        mass = inner @ np.ones(CLASS, h.dtype)
        logp[order] += chosen - np.log(mass)
        if grads is not None:
            inner[rows, member] -= mass
            share = (1 / mass)[:, None]
            states *= share
            more, sums = np.empty((len(order), UNITS), h.dtype), np.zeros_like(weights)
            for c, own in filled:
                np.matmul(inner[own], self.inner[c].T, out=more[own])
                np.matmul(states[own].T, inner[own], out=sums[c])
            more *= share
            back[order] += more
            grads[4] += sums[:, :UNITS]
            grads[5] += sums[:, UNITS]
        return logp, back


class Trainer:
    """Truncated backpropagation with Adam steps."""

    def __init__(self, network: Network):
        self.network, self.t = network, 0
        self.m, self.v = [np.zeros_like(p) for p in network.values()], [np.zeros_like(p) for p in network.values()]

    def window(self, h: np.ndarray, ids: np.ndarray, keep: np.ndarray, told: np.ndarray | None = None) -> np.ndarray:
        """One window: ids and keep (0 where a text starts) by step and row; the state after it.

        Every token is a target, but for those that ``told`` marks False (they fill up the last window of a row).
        """
        net, steps, rows = self.network, len(ids), ids.shape[1]
        inputs, recurrent = net.blocks()
        x = inputs.take(ids, 1)
        before = np.empty((steps, rows, UNITS), h.dtype)
        z, r, un, n = (np.empty_like(before) for _ in range(4))
        whole = (keep != 0).all(1).tolist()
        for t in range(steps):
            before[t] = h if whole[t] else h * keep[t][:, None]
            h, (z[t], r[t], un[t], n[t]) = net.advance(before[t], x[:, t], recurrent)
        grads = [np.zeros_like(p) for p in net.values()]
        if told is None or told.all():
            _, back = net.outputs(before.reshape(-1, UNITS), ids.reshape(-1), grads)
            direct, targets = back.reshape(steps, rows, UNITS), steps * rows
        else:
            _, back = net.outputs(before[told], ids[told], grads)
            direct, targets = np.zeros_like(before), len(back)
            direct[told] = back
        # What a state's gradient becomes in each gate, for all steps at once.
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), un * r * (1 - r)
        # Gradients of the gates' sums (for n without r's factor, which only the recurrent part has), by gate.
        gates, of_n = np.empty((3, steps, rows, UNITS), h.dtype), np.empty_like(before)
        back_through, dh = np.ascontiguousarray(net.recurrent.reshape(UNITS, 3, UNITS).transpose(1, 2, 0)), np.zeros((rows, UNITS), h.dtype)
        for t in range(steps - 1, -1, -1):
            g = gates[:, t]
            dn = np.multiply(dh, by_n[t], out=of_n[t])
            np.multiply(dh, by_z[t], out=g[0])
            np.multiply(dn, by_r[t], out=g[1])
            np.multiply(dn, r[t], out=g[2])
            dh = dh * z[t]
            for through in np.matmul(g, back_through):
                dh += through
            dh += direct[t]
            if not whole[t]:
                dh *= keep[t][:, None]
        flat = ids.reshape(-1)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        ordered = flat.take(order)
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        states = before.reshape(-1, UNITS).T
        for k, (of_inputs, hidden) in enumerate(zip((gates[0], gates[1], of_n), gates, strict=True)):
            own = slice(k * UNITS, (k + 1) * UNITS)
            pairs = of_inputs.reshape(-1, UNITS).take(order, 0).view(np.result_type(h, np.complex64))  # two sums at once
            grads[0][ordered[first], own] = np.add.reduceat(pairs, first).view(h.dtype)
            grads[1][:, own] += states @ hidden.reshape(-1, UNITS)
        self.descend(grads, targets)
        return h

    def descend(self, grads: list[np.ndarray], targets: int) -> None:
        self.t += 1
        rate = RATE * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.network.values(), grads, self.m, self.v, strict=True):
            g /= targets
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * m / (np.sqrt(v) + 1e-6)


def train_part(network: Network, ids: np.ndarray, rows: int, keep: np.ndarray) -> None:
    """Trains on one long row of tokens, cut into up to ``rows`` rows that advance together; every token is a target once.

    The last row is filled up with tokens that are read after all others and are no targets.
    """
    rows = max(1, min(rows, len(ids)))
    length = -(-len(ids) // rows)
    rows = -(-len(ids) // length)
    told = np.arange(rows * length) < len(ids)
    by_row = lambda x: np.resize(x, rows * length).reshape(rows, length).T
    ids, keep, told = by_row(ids), by_row(keep), told.reshape(rows, length).T
    trainer, h = Trainer(network), np.zeros((rows, UNITS), np.float32)
    for at in range(0, length, WINDOW):
        part = slice(at, at + WINDOW)
        h = trainer.window(h, np.ascontiguousarray(ids[part]), keep[part], told[part])


class Reader:
    """Turns texts into ids with a vocabulary, remembering the words outside the head."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.named = dict(islice(vocab.index.items(), vocab.named))
        self.ends = {e: vocab.named + i for e, i in vocab.endings.items()}.get

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Input ids alone: a few words are named, the end of all others tells their id."""
        rest, ending = self.vocab.named + ENDINGS - 1, self.ends
        return np.fromiter([i if i >= 0 else ending(w[-2:], rest) for w, i in zip(words, map(self.named.get, words, repeat(-1)))], np.int32, len(words))

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Input ids; places of head words in the head (-1: none); the other words in order."""
        v = self.vocab
        at = np.fromiter(map(v.index.get, words, repeat(-1)), np.int64, len(words))
        other = np.flatnonzero(at < 0)
        if not len(v.ids):
            return np.fromiter((v.named + v.ending(w) for w in words), np.int32, len(words)), at, words
        out = v.ids[at]
        rare = [words[i] for i in other.tolist()]
        if rare:
            ending = v.endings.get
            out[other] = [v.named + ending(w[-2:], ENDINGS - 1) for w in rare]
        return out, at, rare


def train(texts: DataFrame, vocab: Vocabulary, network: Network, rounds: int = ROUNDS) -> Network:
    """The network after all rounds over texts(text, turn); turn tells the round of each text."""
    context = texts.sparkSession.sparkContext
    shared_vocab = context.broadcast(vocab)
    parts = max(1, texts.rdd.getNumPartitions())
    rows = int(np.clip(vocab.total / parts / rounds / (WINDOW * 150), 8, ROWS))
    for turn in range(rounds):
        shared = context.broadcast(network)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            reader, net = Reader(shared_vocab.value), shared.value.unpacked(np.frombuffer(shared.value.packed()))
            held, held_keep, weight, size = [], [], 0, 0

            def learn() -> None:
                train_part(net, np.concatenate(held), rows, np.concatenate(held_keep))
                held.clear(), held_keep.clear()

            for batch in batches:
                for text in batch.column(0):
                    found = reader.inputs(tokens(text.as_py()))
                    keep = np.ones(len(found), np.float32)
                    keep[0] = 0
                    held.append(found)
                    held_keep.append(keep)
                    size += len(found)
                    weight += len(found)
                if size > TOKENS_AT_ONCE:
                    learn()
                    size = 0
            if held:
                learn()
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([(np.frombuffer(net.packed()) * weight).tobytes()], pa.binary()), pa.array([weight], pa.int64())], ["sums", "weight"])

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weight = None, 0
            for batch in batches:
                for sums, w in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    own = np.frombuffer(sums.as_py())
                    total, weight = own if total is None else total + own, weight + w
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([weight], pa.int64())], ["sums", "weight"])

        copies = small_batches(texts.filter(F.col("turn") == turn).select("text")).mapInArrow(run, "sums binary, weight long")
        few = copies.repartition(max(1, math.isqrt(parts))).mapInArrow(add, "sums binary, weight long").collect()
        if weight := sum(r["weight"] for r in few):
            network = network.unpacked(sum(np.frombuffer(r["sums"]) for r in few) / weight)
        shared.unpersist()
    return network


def score_streams(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text's ids, without what ending classes say within; states run through whole texts."""
    sums = np.zeros(len(texts))
    if not texts:
        return sums
    lengths = np.array([len(t) for t in texts])
    # Longest texts first, each to the stream that is shortest so far: streams come out nearly even.
    streams: list[list[int]] = [[] for _ in range(min(STREAMS, len(texts)))]
    fill = np.zeros(len(streams), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(fill.argmin())
        streams[s].append(i)
        fill[s] += lengths[i]
    order = np.argsort(-fill, kind="stable")
    longest = int(fill.max())
    ids = np.zeros((longest, len(streams)), np.int32)
    owner = np.zeros((longest, len(streams)), np.int32)
    keep = np.ones((longest, len(streams)), np.float32)
    for column, s in enumerate(order.tolist()):
        at = 0
        for i in streams[s]:
            n = lengths[i]
            ids[at : at + n, column], owner[at : at + n, column], keep[at, column] = texts[i], i, 0
            at += n
    active = np.searchsorted(-fill[order], -np.arange(longest), side="left")  # streams longer than t
    h = np.zeros((len(streams), UNITS), np.float32)
    states, now, whose, waiting = [], [], [], 0

    def settle() -> None:
        logp, _ = network.outputs(np.concatenate(states), np.concatenate(now))
        sums[:] += np.bincount(np.concatenate(whose), weights=logp, minlength=len(sums))
        states.clear(), now.clear(), whose.clear()

    inputs, recurrent = network.blocks()
    begins = (keep == 0).any(1).tolist()
    for t, n in enumerate(active.tolist()):
        h = h[:n] * keep[t, :n, None] if begins[t] else h[:n]
        states.append(h)
        now.append(ids[t, :n])
        whose.append(owner[t, :n])
        h, _ = network.advance(h, inputs.take(now[-1], 1), recurrent)
        waiting += n
        if waiting >= 8192:
            settle()
            waiting = 0
    if states:
        settle()
    return sums


def score_texts(docs: DataFrame, vocab: Vocabulary, network: Network) -> DataFrame:
    """One row a document: doc_id, held_out, digest, n_tokens, and sums over its head words; rare words of a text once a batch."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((vocab, network))
    names = ["doc_id", "held_out", "digest", "n_tokens", "known", "base", "score", "told", "rare", "times"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, network = shared.value
        reader, log = Reader(vocab), math.log(10)
        within = np.concatenate((np.zeros(vocab.named), np.log10(vocab.masses)))
        named_log = np.log10(vocab.counts + SMOOTHING) if len(vocab.counts) else np.zeros(1)
        rare_head = (np.arange(len(vocab.counts)) >= vocab.named) if len(vocab.counts) else np.zeros(1, bool)
        norm = math.log10(vocab.base_norm)
        waiting, size = [], 0

        def settle() -> pa.RecordBatch:
            found: dict[bytes, int] = {}
            rows, texts, facts = [], [], []
            for doc_id, held_out, text in waiting:
                digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                first = digest not in found
                if first:
                    found[digest] = len(texts)
                    words = tokens(text)
                    ids, at, rare = reader.ids(words)
                    head = at[at >= 0]
                    logs = named_log[head]
                    times = Counter(rare)
                    texts.append(ids)
                    facts.append((
                        len(words), len(head), float(logs.sum()) - len(words) * norm,
                        float(logs[rare_head[head]].sum()) - float(within[ids].sum()), list(times.keys()), list(times.values()),
                    ))
                rows.append((doc_id, held_out, digest, found[digest], first))
            scores = score_streams(network, texts) / log
            columns = [[] for _ in names]
            for doc_id, held_out, digest, i, first in rows:
                n, known, base, inner, rare, times = facts[i]
                for c, x in zip(columns, (doc_id, held_out, digest, n, known, base, scores[i] + inner, first, rare if first else [], times if first else []), strict=True):
                    c.append(x)
            kinds = [kind, pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            kind = batch.column(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(row)
                size += len(row[2]) // 6 + 1
            if size > TOKENS_AT_ONCE:
                yield settle()
                size = 0
        if waiting:
            yield settle()

    source = small_batches(docs.select("doc_id", "held_out", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, digest binary, n_tokens long, known long, base double, score double, told boolean, rare array<binary>, times array<int>")


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table into a shared folder and reads it back."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def score_documents(docs: DataFrame, held_out: Column, folder: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Texts whose ``held_out`` is false are learned from; ``folder`` is shared by all executors.
    """
    texts = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    taught = texts.filter(~F.col("held_out"))
    counts = stored(word_counts(taught.select("text")), folder, "counts")
    vocab = vocabulary(counts)
    turn = F.pmod(F.xxhash64(F.lit("turn"), "doc_id"), F.lit(rounds)).alias("turn")
    network = train(taught.select("text", turn), vocab, Network.start(vocab), rounds)
    scored = stored(score_texts(texts, vocab, network), folder, "scored")
    rare = scored.filter("told").select("digest", F.explode(F.arrays_zip("rare", "times")).alias("w"))
    rare = rare.select("digest", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    rare = rare.join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    sums = rare.groupBy("digest").agg(
        F.sum(F.col("times") * F.log10(n + SMOOTHING)).alias("logs"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known_rare"),
    )
    # Copies of a text in different batches told its rare words again.
    told = scored.filter("told").groupBy("digest").agg(F.count("*").alias("copies"))
    sums = sums.join(told, "digest").select("digest", (F.col("logs") / F.col("copies")).alias("logs"), (F.col("known_rare") / F.col("copies")).cast("long").alias("known_rare"))
    out = scored.select("doc_id", "held_out", "digest", "n_tokens", "known", "base", "score").join(sums, "digest", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
