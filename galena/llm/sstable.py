"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key. File format, little-endian throughout:

* data blocks: entries of (shared key bytes: u16, own key bytes: u16, ids: u32, own key bytes, ids); the first entry of a
  block shares nothing. Ids take 2 bytes each where the vocabulary allows it, else 4.
* Bloom filter over the keys: bits, set by double hashing.
* block index: for each block its first key (u16 length, bytes), offset (u64), length (u32) and entries (u32).
* footer of fixed size: offsets of filter and index, their lengths, counts of blocks, entries and ids, bytes an id, hashes, magic.

A lookup reads the footer, asks the filter, finds the block by binary search in the index and scans that block.
A key is a flag byte (0: null) and the key's 8 bytes, big-endian with the sign turned, so that bytes sort as numbers do.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.shared import batches, give_back, shared_path, small_batches

MAGIC = b"TOKSST01"
FOOTER = struct.Struct("<QQQQQQQII8s")
ENTRY, PLACE = struct.Struct("<HHI"), struct.Struct("<QII")
BLOCK_BYTES, BITS_A_KEY, HASHES = 64 * 1024, 10, 7
#: Bytes of text for one shard, and for one of a small table.
SHARD_BYTES, LEAST_BYTES = 128 << 20, 1 << 20
#: Bytes of text that a task encodes at a time.
TOGETHER = 20 << 20
MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"


def to_key(value: int | None) -> bytes:
    return b"\0" * 9 if value is None else b"\1" + struct.pack(">Q", value + (1 << 63))


def from_key(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % (1 << 64) % bits for i in range(hashes)]


class ShardWriter:
    """Writes one shard to an open file. Keys have to come in ascending order; equal keys are kept side by side.

    Memory holds one block, the index and the keys' hashes.
    """

    def __init__(self, file, width: int):
        self.file, self.kind = file, "<u2" if width == 2 else "<u4"
        self.width, self.at, self.ids, self.entries = width, 0, 0, 0
        self.block, self.index, self.keys = bytearray(), [], []
        self.first, self.before, self.count = b"", b"", 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.before:
            raise ValueError("keys have to ascend")
        shared = len(os.path.commonprefix([key, self.before])) if self.block else 0
        if not self.block:
            self.first, self.count = key, 0
        self.block += ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype(self.kind).tobytes()
        self.before, self.count, self.entries, self.ids = key, self.count + 1, self.entries + 1, self.ids + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index.append(struct.pack("<H", len(self.first)) + self.first + PLACE.pack(self.at, len(self.block), self.count))
            self.file.write(bytes(self.block))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> int:
        self.flush()
        bits = max(64, BITS_A_KEY * len(self.keys) + 7 & ~7)
        filled = np.zeros(bits, dtype=bool)
        for key in self.keys:
            filled[bloom_places(key, bits, HASHES)] = True
        bloom, index = np.packbits(filled, bitorder="little").tobytes(), b"".join(self.index)
        end = FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), len(self.index), self.entries, self.ids, self.width, HASHES, MAGIC)
        self.file.write(bloom + index + end)
        return self.at + len(bloom) + len(index) + len(end)


class ShardReader:
    """Reads a shard from an open file that can seek."""

    def __init__(self, file):
        self.file = file
        size = file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2)
        bloom_at, bloom_n, index_at, index_n, self.blocks, self.entries, self.ids, width, self.hashes, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no shard of token ids")
        self.width, self.kind, self.bloom_at, self.bloom_n = width, "<u2" if width == 2 else "<u4", bloom_at, bloom_n
        self.firsts, self.places, index, at = [], [], self._read(index_at, index_n), 0
        while at < len(index):
            n = struct.unpack_from("<H", index, at)[0]
            self.firsts.append(index[at + 2 : at + 2 + n])
            self.places.append(PLACE.unpack_from(index, at + 2 + n))
            at += 2 + n + PLACE.size

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, n, _ = self.places[k]
        data, i, key = self._read(at, n), 0, b""
        while i < n:
            shared, own, ids = ENTRY.unpack_from(data, i)
            i += ENTRY.size
            key = key[:shared] + data[i : i + own]
            i += own
            yield key, np.frombuffer(data, self.kind, ids, i)
            i += ids * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def lookup(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry with that key, in order; none if the filter or the block lacks it."""
        bloom, bits = self._read(self.bloom_at, self.bloom_n), self.bloom_n * 8
        if not all(bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, bits, self.hashes)):
            return []
        k, out = max(0, bisect_right(self.firsts, key) - 1), []
        while k and self.firsts[k] == key:  # equal keys may fill blocks
            k -= 1
        while k < len(self.places) and self.firsts[k] <= key:
            out += [ids for own, ids in self.block(k) if own == key]
            k += 1
        return out


#: Names that Hadoop and pyarrow have for one kind of store.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def file_at(path: str):
    """The file system of a path or URI, and the path in it."""
    scheme, mark, rest = path.partition("://")
    if not mark:
        return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:"))
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


#: A blank or line break with letters behind it and then punctuation up to the end, of characters that every version of
#: Unicode has as such; quotation marks may begin a match of letters.
LETTERS_MARKS = r"^(?P<letters>[ \n][A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!#$%&()*+,./:;<=>?@|~\-]+)$"


def gathered(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of the numbered strings, one after the other. ids, sizes: of all strings, in the order of their numbers."""
    n = sizes[codes]
    return ids[np.repeat((np.cumsum(sizes) - sizes)[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def no_blank_ends(strings: pa.Array) -> np.ndarray:
    """Which strings have visible characters at either end."""
    own = pc.and_(pc.equal(pc.utf8_trim_whitespace(strings), strings), pc.greater(pc.binary_length(strings), 0))
    return own.to_numpy(zero_copy_only=False)


class Encoder:
    """A tokenizer of the tokenizers library. encode gives the packed ids of texts, without added special tokens.

    Where the tokenizer works on bytes and keeps them all, texts are cut where its split pattern always parts them, and
    each distinct piece is encoded once for all texts that are given together. Pieces are encoded many at once, one after
    the other, and told apart by the bytes their tokens stand for. Other tokenizers get each text whole.

    Cuts: a blank between two visible characters begins a match; a single line break between two is one by itself;
    punctuation behind letters up to the next cut is one. A text with another neighbourhood of blanks is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        pre = told.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer")
        kept = not told.get("truncation") and not told.get("padding") and not told["model"].get("dropout")
        self.by_bytes = bool(plain and kept and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told.get("added_tokens", [])))
        self.sizes = np.zeros(self.own.get_vocab_size(), np.int64)
        added = {t["id"] for t in told.get("added_tokens", [])}
        for token, i in self.own.get_vocab().items():
            self.sizes[i] = len(token.encode()) if i in added else len(token)

    def many(self, texts: list[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), 64):
            yield from (np.array(e.ids, "<u4") for e in self.own.encode_batch_fast(texts[i : i + 64], add_special_tokens=False))

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and how many each has."""
        found = list(self.many(texts))
        return np.concatenate([*found, np.empty(0, "<u4")]), np.array(list(map(len, found)), np.int64)

    def pieces(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that begin with a blank or line break."""
        texts, ends, ids, sizes = strings.to_numpy(zero_copy_only=False).tolist(), np.cumsum(pc.binary_length(strings).to_numpy()), [], []
        for i in range(0, len(texts), 256):
            own = np.array(self.own.encode_batch_fast(["".join(texts[i : i + 256])], add_special_tokens=False)[0].ids, "<u4")
            to = ends[i : i + 256] - (ends[i - 1] if i else 0)
            at = np.searchsorted(places := np.cumsum(self.sizes[own]), to)
            if at[-1] == len(own) - 1 and (places[at] == to).all():
                ids.append(own)
                sizes.append(np.diff(at, prepend=-1))
            else:
                for kept, x in zip((ids, sizes), self.each(texts[i : i + 256]), strict=True):
                    kept.append(x)
        return np.concatenate([*ids, np.empty(0, "<u4")]), np.concatenate([*sizes, np.empty(0, np.int64)])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of words behind a blank, with visible characters at either end."""
        cut = pc.split_pattern(words, "\n")
        offsets, lines = cut.offsets.to_numpy(), cut.flatten()
        first = np.zeros(len(lines), bool)
        first[offsets[:-1]] = True
        fit = np.logical_and.reduceat(no_blank_ends(lines), offsets[:-1]) if len(words) else np.empty(0, bool)
        odd_ids, odd_sizes = self.each([f" {w}" for w in words.filter(pa.array(~fit)).to_pylist()])
        # A line of an odd word is nothing, but for the first, which stands for the word.
        of_fit = np.repeat(fit, np.diff(offsets))
        led = pc.binary_join_element_wise(pc.if_else(pa.array(first), " ", "\n").cast(lines.type), lines, pa.scalar("", lines.type)).filter(pa.array(of_fit))
        told = pc.extract_regex(led, LETTERS_MARKS)
        stems = pc.coalesce(pc.struct_field(told, "letters"), led).dictionary_encode()
        marks = pc.struct_field(told, "marks").dictionary_encode()
        stem_ids, stem_sizes = self.pieces(stems.dictionary)
        mark_ids, mark_sizes = self.each(marks.dictionary.to_pylist())
        ids, sizes = np.concatenate((stem_ids, mark_ids, odd_ids)), np.concatenate((stem_sizes, mark_sizes, odd_sizes, [0]))
        codes = np.full((len(lines), 2), len(sizes) - 1)  # the last number is of nothing
        codes[of_fit, 0] = stems.indices.to_numpy()
        codes[of_fit, 1] = len(stem_sizes) + pc.fill_null(marks.indices.cast(pa.int64()), len(sizes) - 1 - len(stem_sizes)).to_numpy()
        codes[offsets[:-1][~fit], 0] = len(stem_sizes) + len(mark_sizes) + np.arange(len(odd_sizes))
        return gathered(ids, sizes, codes.ravel()), np.add.reduceat(sizes[codes].sum(axis=1), offsets[:-1]) if len(words) else np.empty(0, np.int64)

    def by_words(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets, numbered = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        codes, words, first = numbered.indices.to_numpy(), numbered.dictionary, offsets[:-1]
        fit, later = no_blank_ends(words), np.ones(len(codes), bool)
        later[first] = False
        asked = np.zeros(len(words), bool)
        asked[codes[later]] = True
        asked &= fit
        ids, own = self.words(words.filter(pa.array(asked)))
        sizes = np.zeros(len(words), np.int64)
        sizes[asked] = own
        heads = words.take(pa.array(codes[first])).to_pylist()
        whole = ~np.logical_and.reduceat(fit[codes] | ~later, first) | np.array([not h or h[-1].isspace() for h in heads])
        ahead = self.many([h for h, w in zip(heads, whole.tolist(), strict=True) if not w])
        out = []
        for i in range(0, len(texts), 512):  # some at a time, as places take more bytes than ids
            x, y = offsets[i], offsets[min(i + 512, len(texts))]
            some, behind = codes[x:y], later[x:y]
            ends = np.concatenate(([0], np.cumsum(sizes[some] * behind)))[offsets[i : i + 513] - x]
            found = gathered(ids, sizes, some[behind])
            for text, w, a, z in zip(texts[i : i + 512], whole[i : i + 512].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out.append((next(self.many([text])) if w else np.concatenate((next(ahead), found[a:z]))).tobytes())
        return out

    def memo(self) -> Callable[[list[str]], list[bytes]]:
        """What encodes texts, better many at once."""
        return self.by_words if self.by_bytes else lambda texts: [x.tobytes() for x in self.many(texts)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def together(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of batches, so many at a time that they have TOGETHER bytes: words that they share are looked up once."""
    keys, texts, size = [], [], 0
    for b in frames:
        keys += b.column("key").to_pylist()
        texts += b.column("text").to_pylist()
        size += b.column("text").nbytes
        if size >= TOGETHER:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def shards_for(texts: DataFrame) -> int:
    """Shards of SHARD_BYTES of text; for small tables more of them, so that all cores take part, down to LEAST_BYTES."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = 3 * texts.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-total // SHARD_BYTES), min(cores, total // LEAST_BYTES))


def write_shards(df: DataFrame, tokenizer: str, end_id: int, path: str, shards: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes the texts and writes them as shards below path; the manifest has a row for each shard that has rows.

    A null text counts as empty: its only id is end_id. Null keys come first, equal keys stay apart as rows. Rows are
    dealt by ranges of key and text digest, so that one key's rows, too, can fill several shards. A shard is written
    under a name of its own and then renamed: a task that is run again leaves the same shard. Columns other than key
    and text are not looked at.
    """
    small_batches(df.sparkSession)
    width = 2 if max(len(encoder(tokenizer).sizes) - 1, end_id) < 1 << 16 else 4
    own = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    ranged = own.repartitionByRange(shards or shards_for(own), *order)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, base = file_at(path)
        name, writer, out, encode = f"{base}/shard-{shard:06d}.sst", None, None, encoder(tokenizer).memo()
        draft = f"{name}.{uuid.uuid4().hex}"
        for keys, texts in together(batches(frames)):
            if writer is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(draft)
                writer = ShardWriter(out, width)
            for k, packed in zip(keys, encode(texts), strict=True):
                writer.add(to_key(k), np.append(np.frombuffer(packed, "<u4"), np.uint32(end_id)))
        del encode
        give_back()
        if writer is not None:
            size = writer.close()
            out.close()
            fs.move(draft, name)
            row = {"shard": shard, "path": f"{path}/shard-{shard:06d}.sst", "n_docs": writer.entries, "n_ids": writer.ids, "n_bytes": size}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    ranged.sortWithinPartitions(*order).mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{path}/_manifest")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def read_shards(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per stored document, from the files: key, start (ids of all documents before it), n_tokens and ids_crc32.

    The manifest has a row for each shard, so its running total takes one small task.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")).repartition(max(1, manifest.count()), "path")
    kinds = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, name = file_at(path)
                with fs.open_input_file(name) as file:
                    reader = ShardReader(file)
                    for k in range(reader.blocks):
                        rows = []
                        for own, ids in reader.block(k):
                            rows.append({"key": from_key(own), "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})
                            start += len(ids)
                        yield pa.RecordBatch.from_pylist(rows, kinds)

    return placed.mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("key", key)


def encode_to_shards(df: DataFrame, tokenizer: str, end_id: int, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """Writes df as shards and returns what the files hold, a row for each document."""
    return read_shards(write_shards(df, tokenizer, end_id, path or shared_path(df.sparkSession, "token-ids"), key=key), key)
