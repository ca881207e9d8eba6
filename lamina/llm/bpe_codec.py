"""Byte-level BPE encoding and decoding over Arrow batches.

A rank file (base64 token, rank) becomes a ``tokenizers`` BPE model: every byte
is shown as one printable character, and each token's possible halves are its
merges, ordered by the token's rank. Decoding turns the printable characters
back into bytes, so a character that several tokens share is put together again.

Defined results: a null text counts as empty (no ids, empty bytes); repeated rows
are encoded alike; an empty table gives an empty table; columns beyond the
named ones are dropped, so clashing names cannot arise.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamina.llm.batches import lean, small_batches, worker_cache

#: Texts handed to the library at once; bounds a task's memory for very long texts.
TEXTS_AT_ONCE = 64

_codecs: dict[tuple[str, str], tuple] = worker_cache("bpe_codec")


def byte_characters() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 stays, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file as token bytes -> rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def codec(path: str, pattern: str) -> tuple:
    """(tokenizer, token bytes by id), built once per worker process."""
    if (path, pattern) not in _codecs:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, shown = read_ranks(path), byte_characters()
        show = lambda token: "".join(map(shown.__getitem__, token))
        merges = [
            (show(token[:cut]), show(token[cut:]))
            for token, _ in sorted(ranks.items(), key=lambda item: item[1])
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        tokenizer = Tokenizer(models.BPE({show(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        by_id = [b""] * (max(ranks.values()) + 1)
        back = {character: byte for byte, character in shown.items()}
        for text, rank in tokenizer.get_vocab().items():
            by_id[rank] = bytes(back[character] for character in text)
        _codecs[path, pattern] = tokenizer, by_id
    return _codecs[path, pattern]


def decoded_bytes(by_id: list[bytes], ids: np.ndarray) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(by_id.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_offsets: bool = False, with_check: bool = False) -> DataFrame:
    """Columns ``keep`` with n_tokens, ids (little-endian unsigned 32-bit integers) and, if asked, offsets and round_trip.

    offsets holds a start and an end for each id in characters of the text; ids that
    share a split character have that character's span. round_trip tells whether decoding the ids gives the text's bytes.
    """
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = [source.schema[name] for name in keep]
    extra = ", n_tokens long, ids binary" + ", offsets array<int>" * with_offsets + ", round_trip boolean" * with_check
    names = list(keep)
    added = ["n_tokens", "ids", *["offsets"] * with_offsets, *["round_trip"] * with_check]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, by_id = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = part.column(len(names)).to_pylist()
                found = (tokenizer.encode_batch if with_offsets else tokenizer.encode_batch_fast)(texts, add_special_tokens=False)
                ids = [np.array(x.ids, "<u4") for x in found]
                columns = [part.column(i) for i in range(len(names))]
                columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if with_offsets:
                    columns.append(pa.array([[n for pair in x.offsets for n in pair] for x in found], pa.list_(pa.int32())))
                if with_check:
                    columns.append(pa.array([decoded_bytes(by_id, x) == t.encode() for x, t in zip(ids, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return small_batches(source).mapInArrow(lean(run, "bpe_codec"), schema + extra)


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Columns ``keep`` with the bytes that ids stand for; ``ids`` must be among them."""
    source = encoded.select(*keep)
    names, at_ids = list(keep), list(keep).index("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, by_id = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                out = [decoded_bytes(by_id, np.frombuffer(x or b"", "<u4")) for x in part.column(at_ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    schema = ", ".join(f"`{name}` {source.schema[name].dataType.simpleString()}" for name in names)
    return source.mapInArrow(lean(run, "bpe_codec"), schema + ", decoded binary")


def decode_stream(chunks: Iterable[bytes]) -> Iterator[str]:
    """Text of ids' bytes that arrive piece by piece; a split character waits for its rest."""
    waiting = codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in chunks:
        yield waiting.decode(chunk)
    if rest := waiting.decode(b"", True):
        yield rest
