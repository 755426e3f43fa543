"""Operator 11 against plain loops and SQL."""

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from galena.llm import oracles, queries, spelling

SF = "/root/testdata/sf0.001"


def brute(rows, shortest=5, least=3, times=2, every=97):
    """The operator's rows by plain loops: all words against all that lack a letter of theirs."""
    words = Counter()
    for key, text in rows:
        for run in spelling.RUN.findall((text or "").encode().lower().decode()):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            words[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in words.items() if len(w) >= shortest and n >= least}
    lacking, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            lacking[i, w[:i] + w[i + 1 :]].add(w)
    for (_, left), some in lacking.items():
        for w in some:
            near[w] |= some - {w}
            if left in words:
                near[w].add(left)
                near[left].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_variants_against_loops_and_sql(spark, small_docs):
    got = rows_of(queries.op11_spelling_variants(spark, SF))
    want = brute([tuple(r) for r in small_docs.select("doc_id", "text").collect()])
    assert len(got) == len(want) and set(got) == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    told = con.execute(f"select word, form, root, n, n_near, form_n from ({oracles.OP11})").fetchall()
    assert set(told) == want and len(told) == len(want)


def test_every_single_edit_is_found_once(spark):
    base = ["aaaaaa", "abcabca", "éléments", "xxaaaayy", "abcdefghijk"]
    words = set(base)
    for w in base:
        for i in range(len(w) + 1):
            words |= {w[:i] + w[i + 1 :], w[:i] + "a" + w[i:], w[:i] + "é" + w[i + 1 :]}
    words = sorted(words - {""})
    pairs = spelling.near_pairs(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n bigint")).collect()

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    want = {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}
    assert {frozenset((r.a, r.b)) for r in pairs} == want and len(pairs) == len(want)
    assert all(len(r.a) > len(r.b) or (len(r.a) == len(r.b) and r.a < r.b) for r in pairs)


def test_chains_of_forms_lead_to_their_ends(spark):
    chain = ["aaaaa" + "b" * i for i in range(12)]
    formed = spark.createDataFrame([(w, 1, 0, nxt, 2) for w, nxt in zip(chain, [*chain[1:], None], strict=True)], "word string, n bigint, n_near bigint, form string, form_n bigint")
    assert {r.root for r in spelling.with_roots(formed).collect()} == {chain[-1]}


@pytest.mark.parametrize("every", [97, 2])
def test_messy_rows(spark, messy, every):
    extra = messy.selectExpr("*", "'w' as word", "1 as n")
    got = rows_of(spelling.spelling_variants(extra, least=1, every=every))
    want = brute([tuple(r) for r in messy.select("doc_id", "text").collect()], least=1, every=every)
    assert set(got) == want and len(got) == len(want) and any(len(r[0]) > 2000 for r in got)
    assert rows_of(spelling.spelling_variants(messy.limit(0))) == []
    assert rows_of(spelling.spelling_variants(messy.where("text is null"))) == []
