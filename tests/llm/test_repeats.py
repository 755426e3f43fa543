"""Operator 6 against a count of all 400-byte strings."""

import hashlib
import random
from collections import Counter

from galena.llm import queries, suffix_dedup
from tests.llm.conftest import SF


def brute(texts, width=400):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if counts[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(d)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def got(frame, key="doc_id"):
    return sorted((r[key] is not None, r[key], r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in frame.collect())


def test_op6_against_brute_force(spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    want = {k: w for (k, _), w in zip(rows, brute([t for _, t in rows]), strict=True)}
    result = queries.op6_suffix_dedup(spark, SF).collect()
    assert len(result) == len(rows) and sum(w[1] > 0 for w in want.values()) > 3
    for r in result:
        assert tuple(r)[1:5] == want[r.doc_id] and r.has_repeat == (r.n_removed > 0), r.doc_id


def test_edges_periods_and_parts(spark):
    draw = random.Random(4)
    text = lambda n: "".join(draw.choice("abcdefghij é") for _ in range(n))
    a, b = text(1500), text(700)
    texts = [a, a[200:900] + text(50), text(30) + a[200:601], text(5) + a[800:1199], b + text(3) + b[:399], b[:400] + text(9), "ab" * 900, "x" * 399, "x" * 401, "x" * 500, text(90) + a[:650] + text(40) + a[640:1300], b[300:] + a[:10] + b[:300]]
    rows = list(enumerate(texts))
    for _ in range(30):  # cuts around the width
        i, n = draw.randrange(1000), draw.choice((399, 400, 401, 420, 500))
        rows.append((len(rows), text(draw.randrange(20)) + a[i : i + n] + text(draw.randrange(20))))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted((True, k, *w) for (k, _), w in zip(rows, brute([t for _, t in rows]), strict=True))
    assert got(suffix_dedup.remove_repeats(frame)) == want


def test_parts_of_a_text_change_nothing(monkeypatch):
    draw = random.Random(7)
    text = bytes(draw.choices(b"abcd ", k=30_000)) + b"ab" * 700 + bytes(draw.choices(b"abcd ", k=5_000))
    whole = suffix_dedup.sampled(text, 3, len(text) - 5)
    runs = lambda: {w: (a, g) for part in suffix_dedup.runs_of(text) for f, last, a, g, _ in zip(*(x.tolist() for x in part), strict=True) for w in range(f, last + 1)}
    one = runs()
    monkeypatch.setattr(suffix_dedup, "PART", 1 << 10)
    assert suffix_dedup.sampled(text, 3, len(text) - 5).tolist() == whole.tolist() and len(whole) > 500
    assert runs() == one and len(one) == len(text) - 399


def test_long_texts_and_ranks(spark):
    # Two texts of 600 KB that share passages across the parts of their hashes; ranks decide all of it.
    draw = random.Random(9)
    text = lambda n: "".join(draw.choices("abcdefghij klmnop", k=n))
    shared = [text(n) for n in (400, 399, 900, 5000)]
    a = text(262_000) + shared[0] + text(90) + shared[1] + text(200_000) + shared[2] + text(140_000)
    b = text(261_800) + shared[2] + text(100) + shared[0] + text(330_000) + shared[3] + text(500) + shared[3][:2500] + text(3) + shared[1]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (1300, 2) and (got[2].n_removed, got[2].n_spans) == (1300 + 5000, 4)


def test_messy_rows(spark, messy):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    want = sorted(((k is not None, k, *w) for (k, _), w in zip(rows, brute([t for _, t in rows]), strict=True)), key=str)
    assert sorted(got_messy(suffix_dedup.remove_repeats(messy)), key=str) == want
    assert suffix_dedup.remove_repeats(messy.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "q" + "".join(map(str, range(300))))] * 2, "doc_id bigint, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeats(twice).collect()] == [791, 791]


def got_messy(frame):
    return [(r.doc_id is not None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in frame.collect()]
