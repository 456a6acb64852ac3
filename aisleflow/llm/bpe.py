"""Byte-level BPE through a sentencepiece model serialised from a rank file.

The rank file is turned into a BPE model message: every token's bytes become characters (one per
byte), its score is the negative rank, and the normaliser is the identity. Merging by the highest
score is then merging by the lowest rank. Each pre-token is encoded on its own; decoding maps ids
back to their bytes.
"""

from __future__ import annotations

import base64
import gc
import itertools
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleflow.llm.storage import without

#: Units remembered by a worker in each of two generations; more only cost time. About 200 bytes each.
MEMO = 500_000
#: Units that are one pre-token in any pattern with runs of letters behind an optional space.
PLAIN = re.compile(" ?[A-Za-z]+").fullmatch
#: Texts handled at a time, so that a batch of very long texts is never held twice.
SLICE = 256

# The characters of the Unicode property White_Space.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Units of a text: white space with what follows up to the next white space. A pattern that never
#: matches from a character that isn't white space into white space splits each unit on its own.
UNITS = re.compile(rf"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+").findall


def byte_chars() -> list[str]:
    """One printable character for each byte: visible Latin-1 characters stand for themselves,
    the other bytes are moved above U+0100 in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(visible) else chr(next(moved)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a file of ``base64 rank`` lines; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not consecutive from 0")
    return [t for _, t in pairs]


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def serialise_model(tokens: list[bytes]) -> bytes:
    """The model message. Piece 0 is the unknown piece, piece ``rank + 1`` the token of that rank."""
    chars = byte_chars()
    # Field numbers and enumerations of the public model message. Piece: 1 text, 2 score,
    # 3 type (2 unknown). Trainer: 3 model type (2 BPE), 4 vocabulary size. Normaliser: 1 name, 3 dummy prefix, 4 extra spaces, 5 escaping.
    piece = lambda text, score, kind=1: _field(1, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind]))
    pieces = [piece("⁇unk", 0.0, 2)]
    pieces += [piece("".join(chars[b] for b in t), -float(rank)) for rank, t in enumerate(tokens)]
    trainer = b"\x18\x02" + b"\x20" + _varint(len(tokens) + 1)
    normaliser = _field(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary, built once per worker."""

    def __init__(self, path: str, pattern: str, memo: int | None = None):
        import sentencepiece

        tokens = read_ranks(path)
        chars = byte_chars()
        self.rank = {"".join(chars[b] for b in t): i.to_bytes(4, "little") for i, t in enumerate(tokens)}
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.table = dict(enumerate(chars))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.split = regex.compile(pattern).findall
        self.most = MEMO if memo is None else memo
        self.young: dict[str, bytes] = {}  # ids as bytes of 32-bit integers
        self.old: dict[str, bytes] = {}

    def merge(self, pretokens: list[str]) -> None:
        """Remember the ids of pre-tokens; a pre-token that is a token is not merged."""
        space, table, rank = self.table[32], self.table, self.rank
        spelled = [p.replace(" ", space) if PLAIN(p) else p.encode("utf-8").decode("latin-1").translate(table) for p in pretokens]
        whole = list(map(rank.get, spelled))
        self.young.update((p, r) for p, r in zip(pretokens, whole, strict=True) if r is not None)
        todo = [p for p, r in zip(pretokens, whole, strict=True) if r is None]
        found = self.model.encode([t for t, r in zip(spelled, whole, strict=True) if r is None], num_threads=1) if todo else []
        sizes = list(map(len, found))
        data = (np.fromiter(itertools.chain.from_iterable(found), np.int32, sum(sizes)) - 1).astype("<i4").tobytes()
        ends = [0, *itertools.accumulate(4 * n for n in sizes)]
        self.young.update(zip(todo, map(data.__getitem__, map(slice, ends, ends[1:])), strict=True))

    def learn(self, units: set[str]) -> None:
        """Remember the ids of units. A pre-token is a unit too, so one memo serves both."""
        young, old = self.young, self.old
        if old:
            known = [u for u in units if u in old]
            young.update(zip(known, map(old.__getitem__, known), strict=True))
            units = units.difference(known)
        single = [u for u in units if PLAIN(u)]
        parts = [(u, self.split(u)) for u in units.difference(single)]
        fresh = {p for _, ps in parts for p in ps if p not in young}
        known = [p for p in fresh if p in old]
        young.update(zip(known, map(old.__getitem__, known), strict=True))
        fresh.difference_update(known)
        self.merge(list(fresh.union(single)))
        young.update((u, b"".join(map(young.__getitem__, ps))) for u, ps in parts if len(ps) > 1)

    def encode_batch(self, texts: list[str | None]) -> pa.Array:
        """The ids of each text."""
        units = [UNITS(t) if t else [] for t in texts]
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        self.learn(set().union(*units).difference(self.young))
        data = [b"".join(map(self.young.__getitem__, u)) for u in units]
        offsets = np.cumsum([0] + [len(x) // 4 for x in data]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), "<i4")))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text]).to_pylist()[0]

    def decode_batch(self, ids: pa.Array) -> pa.Array:
        """Bytes of each list: the bytes of its tokens, gathered from one table."""
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        counts = np.where(nulls, 0, ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.tokens)):
            raise ValueError("id outside the vocabulary")
        lengths = self.lengths[flat]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        at = np.arange(ends[-1]) + np.repeat(self.starts[flat] - ends[:-1], lengths)
        data = self.bytes[at].tobytes()
        edges = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return pa.array([None if null else data[i:j] for null, i, j in zip(nulls.tolist(), edges, edges[1:], strict=False)], pa.binary())


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, memo: int | None = None) -> Codec:
    gc.set_threshold(1_000_000)  # the memos hold many small tuples without cycles
    return Codec(path, pattern, memo)


def encode_column(text: Column, path: str, pattern: str, memo: int | None = None) -> Column:
    """Token ids of a text column; the ids of a null or empty text are an empty list."""

    @F.arrow_udf("array<int>")
    def run(batch: pa.Array) -> pa.Array:
        c = codec(path, pattern, memo)
        parts = [c.encode_batch(batch.slice(i, SLICE).to_pylist()) for i in range(0, len(batch), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return run(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of a column of ids; null ids give null. An id outside the vocabulary fails the task."""

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        parts = [c.decode_batch(batch.slice(i, SLICE)) for i in range(0, len(batch), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return run(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids", memo: int | None = None) -> DataFrame:
    """``docs`` with the token ids of every whole text.

    Every match of ``pattern`` is encoded on its own, without special tokens. No match of the pattern
    may run from a character that isn't white space into white space, and ASCII letters behind an
    optional space must be one match (true of the usual byte-level patterns); repeated units are then
    looked up whole; ``memo`` units in each of two generations are remembered (``MEMO`` by default), which
    changes memory and time, never results. Edge cases: null and
    empty texts have no ids; a column already named like ``out`` is replaced; other columns, null or
    not, and repeated rows pass unchanged; an empty frame gives an empty frame. No shuffle.
    """
    kept = docs if text.lower() == out.lower() else without(docs, out)
    return kept.withColumn(out, encode_column(F.col(text), path, pattern, memo))
