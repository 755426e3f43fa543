"""Operators 4, 5 and 7 against the libraries they stand for."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from galena.llm import byte_bpe, queries, sstable, token_counts
from galena.llm.units import UnitMemo
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_equals_library_on_odd_texts(ranks):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    memo = UnitMemo(byte_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).packed_many)
    draw, letters = random.Random(1), [*"  ab'sx\n\t1é漢  !\x1c.", "<|endoftext|>", "'ll"]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(2000)]
    for text, packed in zip(texts, memo.packed(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text), repr(text)


def test_tables_append_and_edit(ranks):
    own = byte_bpe.PrefixCodec(ranks, P.PATTERN)
    data = b"unbelievably"
    table = own.extend([], data)
    assert own.extend(table[:], data + b"ness") == own.extend([], data + b"ness")
    edited = data[:6] + b"XY" + data[8:]
    assert own.edited(table, edited, 6) == own.extend([], edited)
    for end in range(1, len(data) + 1):
        assert own.ids(table[:end]) == own.merged(data[:end])
    assert own.decode(own.ids(table)) == data


def test_op5_round_trip(spark, small_docs, ranks):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in small_docs.collect()}
    got = queries.op5_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_keeps_nulls_and_clashing_columns(messy):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.decode_frame(byte_bpe.encode_frame(messy, path, P.PATTERN), path, P.PATTERN)
    rows = out.collect()
    assert len(rows) == messy.count() and out.columns[: len(messy.columns)] == messy.columns
    assert all((r.decoded is None) == (r.text is None) and (r.text is None or bytes(r.decoded).decode() == r.text) for r in rows)
    assert byte_bpe.encode_frame(messy.limit(0), path, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode_frame(messy, path, P.PATTERN, ids="key")


def test_op4_counts(spark, small_docs):
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in small_docs.collect()}
    for r in queries.op4_token_counts(spark, SF).collect():
        n = len(own.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 2048)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_messy_texts_and_cache(spark, messy, tmp_path, name):
    path, cache = P.path(name), f"file://{tmp_path}/cache"
    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(own.encode(t))
    else:
        own = Tokenizer.from_file(path)
        count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    want = sorted(((-1 if r.doc_id is None else r.doc_id), count(r.text or "")) for r in messy.collect())
    for _ in range(2):
        got = token_counts.count_tokens(messy, path, cache).collect()
        assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens) for r in got) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.count_tokens(messy.limit(0), path).count() == 0


def test_op7_files(spark, small_docs):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start = 0
    got = {r.doc_id: r for r in queries.op7_token_shards(spark, SF).collect()}
    for r in sorted(small_docs.collect(), key=lambda r: r.doc_id):
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (start, len(ids))
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_shard_encoder_equals_library_on_odd_texts(name):
    library, encode = Tokenizer.from_file(P.path(name)), sstable.encoder(P.path(name)).memo()
    draw, letters = random.Random(2), [*"  ab'sx\n\t1é漢  !\x1c.", "<|endoftext|>", "'ll", " plain words here "]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(2000)]
    for text, packed in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_shard_encoder_encodes_a_word_once_beside_marks_and_line_breaks():
    path, sent = P.path("byte_bpe_50k.json"), []

    class Counting:
        def __init__(self, own):
            self.own = own

        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return self.own.encode_batch_fast(texts, **kw)

    own = sstable.Encoder(path)
    library, own.own = own.own, Counting(own.own)
    draw, words = random.Random(3), ["ondeé", "erreth", "x's", "d'", "<|endoftext|>", "7a", "漢字", "\x1c", "a\tb", "ÿ", "\r"]
    texts = ["".join(draw.choice(words) + draw.choice(["", "", "!", "...", ",'", "$$$", "\u201d", "-x"]) + draw.choice([" ", " ", "\n", "\n\n", " \n", "\r\n"]) for _ in range(8)) + "end" for _ in range(1500)]
    for text, packed in zip(texts, own.memo()(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    sent.clear()
    own.memo()(["first erreth erreth, erreth. erreth\nerreth!\nerreth erreth\nerreth... end"] * 3)
    assert "".join(sent).count("erreth") == 2  # behind a blank and behind a line break


def test_shards_of_messy_rows_and_lookup(spark, messy, tmp_path):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    manifest = sstable.write_shards(messy, P.path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/s", shards=3)
    assert sstable.read_shards(manifest).count() == messy.count()
    found = {}
    for m in manifest.collect():
        with open(m.path.removeprefix("file://"), "rb") as file:
            reader = sstable.ShardReader(file)
            for k in (None, 1, 5, 9, 77):
                found.setdefault(k, []).extend(x.tolist() for x in reader.lookup(sstable.to_key(k)))
    want = {k: sorted([*own.encode(r.text or "", add_special_tokens=False).ids, 2] for r in messy.collect() if r.doc_id == k) for k in found}
    assert {k: sorted(v) for k, v in found.items()} == want
    empty = sstable.write_shards(messy.limit(0), P.path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/e")
    assert sstable.read_shards(empty).count() == 0


def test_keys_sort_as_numbers():
    values = [None, -(1 << 63), -5, 0, 7, (1 << 63) - 1]
    assert sorted(map(sstable.to_key, values)) == list(map(sstable.to_key, values))
    assert [sstable.from_key(sstable.to_key(v)) for v in values] == values
