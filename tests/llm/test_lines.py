"""Operator 8: blocks found by comparing every pair of documents, and the alignment by hand."""

import hashlib
import random

from galena.llm import line_align, queries
from tests.llm.conftest import SF


def brute(rows, least=20):
    """rows: (key, text), keys distinct. Text and number of deleted lines: those in stretches of worded lines, of 20 words
    or more, that any earlier text has, by plain comparison of all places with equal lines."""
    worded = {k: [(i, x) for i, x in enumerate((t or "").split("\n")) if x.encode().split()] for k, t in rows}
    places = {k: {} for k in worded}
    for k, lines in worded.items():
        for j, (_, x) in enumerate(lines):
            places[k].setdefault(x, []).append(j)
    out = {}
    for k, t in rows:
        own, gone = worded[k], set()
        for other in (o for o in worded if o < k):
            for i, (_, x) in enumerate(own):
                for j in places[other].get(x, ()):
                    n = 0
                    while i + n < len(own) and j + n < len(worded[other]) and own[i + n][1] == worded[other][j + n][1]:
                        n += 1
                    if sum(len(x.encode().split()) for _, x in own[i : i + n]) >= least:
                        gone |= {own[m][0] for m in range(i, i + n)}
        out[k] = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone), len(gone)
    return out


def test_op8_deletes_what_earlier_documents_hold(spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    want = brute(rows)
    got = {r.doc_id: r for r in queries.op8_line_dedup(spark, SF).collect()}
    assert len(got) == len(rows) and any(n for _, n in want.values())
    for k, t in rows:
        assert got[k].n_lines == (t or "").count("\n") + 1
        assert (got[k].n_removed, got[k].kept_sha256) == (want[k][1], hashlib.sha256(want[k][0].encode()).hexdigest()), k


def test_passages_over_several_lines(spark):
    draw = random.Random(2)
    line = lambda n: " ".join(f"v{draw.randrange(10**6)}" for _ in range(n))
    passage = [line(9) for _ in range(7)]
    rows = [(i, "\n".join([*(line(12) for _ in range(i % 4)), "", *passage[i % 3 :], line(30)])) for i in range(30)]
    rows += [(100, "\n".join(passage[2:4])), (101, "\n".join(passage[1:2]))]
    got = {r.doc_id: r.text for r in line_align.dedupe_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i in range(3, 30):
        assert not set(passage[2:]) & set(got[i].split("\n")) and got[i].split("\n")[-1] == rows[i][1].split("\n")[-1]
    was = dict(rows)
    assert all(got[k] == was[k] for k in (0, 100, 101))  # the first holder, and runs of nine and eighteen words


def test_reordered_and_twice_held_passages(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    a, b, tail = [line("a", 12), line("aa", 12)], [line("b", 12), line("bb", 12)], line("t", 3)
    texts = {1: [*b, line("y", 25), *a], 2: [*a, tail], 3: [*a, line("x", 25), *b], 4: [*a, line("z", 5), *a], 5: [line("q", 3), *a, tail], 6: [*b, *b, *b, *a]}
    rows = [(k, "\n".join(x)) for k, x in texts.items()]
    got = {r.doc_id: r.text.split("\n") for r in line_align.dedupe_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[2] == [tail] and got[3] == [line("x", 25)] and got[4] == [line("z", 5)] and got[5] == [line("q", 3)] and got[6] in ([], [""])


def test_shuffled_passages_against_every_earlier_document(spark):
    draw = random.Random(8)
    lines = [" ".join(f"l{i}w{k}" for k in range(draw.choice((1, 3, 7, 11, 19, 25)))) for i in range(12)]
    rows = [(i, "\n".join(draw.choice(lines) if draw.random() < 0.9 else f"own {i}" for _ in range(draw.randrange(1, 14)))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least in (20, 8):
        got = {r.doc_id: (r.text, r.n_removed_) for r in line_align.dedupe_lines(frame, min_words=least).collect()}
        assert got == brute(rows, least)


def test_nothing_goes_that_is_not_aligned(monkeypatch):
    tell = lambda s: {i: ord(c) for i, c in enumerate(s) if c != " "}
    cases = [("abcd", "abcd"), ("cdab", "abcd"), ("dcba", "abcd"), ("ababab", "xab"), ("ab", "ayb ab"), ("abcabc", "bcabca")]
    words = lambda a: dict.fromkeys(a, 10)
    blocks = lambda a, b: line_align.common_blocks(tell(a), tell(b), words(tell(a)), 20)
    assert [blocks(*c) for c in cases] == [[0, 1, 2, 3], [0, 1, 2, 3], [], [0, 1, 2, 3, 4, 5], [0, 1], [0, 1, 2, 3, 4, 5]]
    monkeypatch.setattr(line_align, "patience", lambda a, b: [])
    assert [blocks(*c) for c in cases] == [[]] * len(cases)


def test_blocks_of_a_pair_against_all_diagonals():
    draw = random.Random(3)
    for _ in range(400):
        a, b = ([draw.randrange(6) for _ in range(draw.randrange(1, 25))] for _ in range(2))
        weight = [draw.choice((3, 8, 12, 20)) for _ in range(6)]
        want = set()
        for i in range(len(a)):
            for j in range(len(b)):
                if a[i] == b[j] and (not i or not j or a[i - 1] != b[j - 1]):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if sum(weight[x] for x in a[i : i + n]) >= 20:
                        want |= set(range(i, i + n))
        common = set(a) & set(b)
        later, earlier = ({p: x for p, x in enumerate(s) if x in common} for s in (a, b))
        assert set(line_align.common_blocks(later, earlier, {p: weight[x] for p, x in later.items()}, 20)) == want


def test_patience_by_hand():
    seq = lambda s: dict(enumerate(map(ord, s)))
    assert line_align.patience(seq("abcde"), seq("abXde".replace("X", "c"))) == [(i, i) for i in range(5)]
    assert line_align.patience({0: 1, 2: 3}, {0: 3, 5: 1}) in ([(0, 5)], [(2, 0)])
    assert line_align.longest_ascent([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    assert line_align.patience({}, {}) == []


def test_messy_rows(spark, messy):
    got = line_align.dedupe_lines(messy)
    assert got.columns == [*messy.columns, "n_lines_", "n_removed_"]
    assert sorted(str(r.text) for r in got.collect()) == sorted(str(r.text) for r in messy.collect())
    assert line_align.dedupe_lines(messy.limit(0)).count() == 0
    named = messy.selectExpr("*", "1 as own_key", "'a' as of_key", "array(1) as lost", "2 as __key", "3 as __gone")
    assert line_align.dedupe_lines(named).columns == [*named.columns, "n_lines_", "n_removed_"]
    assert [tuple(r)[-7:-2] for r in line_align.dedupe_lines(named).collect()] == [(1, "a", [1], 2, 3)] * messy.count()
    twice = spark.createDataFrame([(None, "x y " * 15), (3, "x y " * 15), (3, "x y " * 15)], "doc_id bigint, text string")
    assert sorted((r.doc_id is None, r.n_removed_) for r in line_align.dedupe_lines(twice).collect()) == [(False, 0), (False, 0), (True, 1)]
