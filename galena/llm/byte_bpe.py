"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its encoding: the suffix token whose pair with the
last token of the remaining prefix is itself a valid encoding. The table of those last tokens is all the state there
is: ids are read off it from the end, appended bytes only extend it, and after an edit it stays valid up to the edit.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.shared import batches, give_back, small_batches
from galena.llm.units import UnitMemo

#: Token pairs whose validity one worker remembers (some 60 bytes each), and pieces whose ids a task remembers (some 200
#: bytes each), of so many bytes at most.
PAIRS, PIECES, PIECE_BYTES = 300_000, 150_000, 48


class PrefixCodec:
    """One vocabulary of ranks with its table of valid pairs.

    A piece is a byte string that the split pattern gave; merges never cross pieces.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        # By left token, then right; both are the vocabulary's own integers, so a pair costs a place in a table only.
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the adjacent pair of lowest rank until none is left."""
        none, get = 1 << 40, self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        near = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while near and (best := min(near)) != none:
            at = near.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            for i in (at - 1, at):
                if 0 <= i < len(near):
                    near[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their joined bytes."""
        if self.n_pairs >= PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known = self.pairs.setdefault(left, {})[right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """Completes the table of last tokens for the prefixes of data that it does not cover yet, in place."""
        get, pairs, none, follows, longest = self.ranks.get, self.pairs, {}, self.follows, self.longest
        near = len(last) - len(self.tokens[last[-1]]) if last else 0  # where the last token of the prefix before starts
        for end in range(len(last) + 1, len(data) + 1):
            # There is one valid token, so any order finds it: most often it is the one before with a byte more.
            start, down = near, end
            while True:
                token = get(data[start:end])
                if token is not None:
                    if not start:
                        break
                    left = last[start - 1]
                    fits = pairs.get(left, none).get(token)
                    if follows(left, token) if fits is None else fits:
                        break
                down -= 1
                if down == near:
                    down -= 1
                if down < 0 or end - down > longest:
                    raise ValueError("the ranks lack a single byte")
                start = down
            last.append(token)
            near = start
        return last

    def edited(self, last: list[int], data: bytes, at: int) -> list[int]:
        """The table after bytes from position `at` on have changed to those of data; what lies before is kept."""
        return self.extend(last[:at], data)

    def ids(self, last: list[int]) -> list[int]:
        """The ids that a table of last tokens stands for."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.ids(self.extend([], data))

    def packed_many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, each match of the pattern by itself.

        New pieces are taken in order, so that each one's table starts as that of the piece before, up to where they
        part. Short pieces are remembered.
        """
        found = [self.pattern.findall(t) for t in texts]
        need = set().union(*found) if found else set()
        if len(self.pieces) + len(self.older) > PIECES:  # what is in use comes back from the older half
            self.older, self.pieces = self.pieces, {}
        need = {m for m in need if m not in self.pieces}
        own = {m: self.older[m] for m in need if m in self.older}
        last, before = [], b""
        for data in sorted(m.encode() for m in need if m not in own):
            whole = self.ranks.get(data)
            if whole is None:
                same, most = 0, min(len(data), len(before), len(last))
                while same < most and data[same] == before[same]:
                    same += 1
                last, before = self.edited(last, data, same), data
            ids = [whole] if whole is not None else self.ids(last)
            own[data.decode()] = struct.pack(f"<{len(ids)}I", *ids)
        self.pieces.update((m, v) for m, v in own.items() if len(m) <= PIECE_BYTES)
        pieces = self.pieces
        for ms in found:
            yield b"".join([pieces[m] if m in pieces else own[m] for m in ms])

    def forget(self) -> None:
        """Lets go of the remembered pieces, as a task does at its end."""
        self.pieces, self.older = {}, {}

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.packed_many([text])), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one line a token, its bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> PrefixCodec:
    """The worker's codec of a rank file."""
    return PrefixCodec(read_ranks(path), pattern)


def encode_frame(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the token ids of the text column as an array of integers, and what they decode to if `decoded` names a column
    for it; all other columns stay, whatever their names.

    A null text gives null, an empty text an empty array and no bytes. Each row is encoded by itself: repeated rows
    repeat.
    """
    added = [ids] if decoded is None else [ids, decoded]
    if set(added) & set(df.columns):
        raise ValueError(f"columns {', '.join(added)}: one exists; give other names")
    small_batches(df.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        memo = UnitMemo(own.packed_many)
        for b in batches(frames):
            at = b.schema.get_field_index(text)
            texts = b.column(at).to_pylist()
            packed = [np.frombuffer(p, "<u4") for p in memo.packed([t or "" for t in texts])]
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in packed]))).astype("i4")
            values = np.concatenate(packed).astype("i4")
            mask = pa.array([t is None for t in texts])
            made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)]
            if decoded is not None:
                made.append(pa.array([None if t is None else own.decode(p.tolist()) for t, p in zip(texts, packed, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *added])
        del memo
        own.forget()
        give_back()

    kinds = [F.lit(None).cast(k).alias(c) for c, k in zip(added, ("array<int>", "binary"), strict=False)]
    return df.mapInArrow(run, df.select("*", *kinds).schema)


def decode_frame(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Adds the bytes that the id column stands for; a null array gives null, an empty one empty bytes."""
    if data in df.columns:
        raise ValueError(f"column {data} exists; give another name for the bytes")
    small_batches(df.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for b in batches(frames):
            column = b.column(b.schema.get_field_index(ids))
            out = [None if x is None else own.decode(x) for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, data])

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("binary").alias(data)).schema)


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; a path of one's own is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
