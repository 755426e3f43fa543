"""Operator 3 against all pairs."""

import re

import pytest
from pyspark.sql import functions as F

from galena.llm import components, ngram_join, queries
from tests.llm.conftest import SF


def brute(rows):
    """(key, text) → (key, set size, smallest key reachable) by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [k for j, (k, _) in enumerate(rows) if root(j) == root(i) and k is not None]
        out.append((key, len(sets[i]), min(keys) if keys else None))
    return out


def plain(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_op3_against_all_pairs(spark, small_docs):
    want = brute([(r.doc_id, r.text) for r in small_docs.collect()])
    assert plain(queries.op3_ngram_join(spark, SF).collect()) == plain(want)
    assert any(k != c for k, _, c in want)


@pytest.mark.parametrize("frequent", [1, 10_000])
def test_chains_groups_and_common_passages(spark, frequent):
    import random

    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(120)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    rows = []
    for i in range(40):  # a chain: each text drifts from the one before
        at = draw.randrange(len(base))
        base = [*base[:at], draw.choice(words), *base[at + 1 :]]
        rows.append((100 + i, " ".join(base)))
    rows += [(200 + i, passage + " " + " ".join(draw.choice(words) for _ in range(draw.randrange(5, 60)))) for i in range(30)]
    rows += [(300 + i, "Exact Copy of one text " + "and more " * 3) for i in range(5)] + [(7, "a b"), (8, "A  b"), (9, "a b c")]
    old, ngram_join.FREQUENT = ngram_join.FREQUENT, frequent
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    ngram_join.FREQUENT = old
    assert plain(got) == plain(brute(rows))


def test_messy_rows(spark, messy):
    want = brute([(r.doc_id, r.text) for r in messy.collect()])
    assert plain(ngram_join.similarity_components(messy).collect()) == plain(want)
    assert ngram_join.similarity_components(messy.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(50)}}


def brute_links(rows):
    """(key, text) → (key, set size, linked rows) by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    link = lambda x, y: x and y and 100 * len(x & y) >= 75 * len(x | y)
    return [(key, len(sets[i]), sum(bool(link(sets[i], s)) for j, s in enumerate(sets) if i != j)) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize("salted", [3, 500])
def test_every_link_of_a_family_is_counted(spark, salted, messy):
    import random

    draw = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # near copies with different sets: nearly all pairs link
        at = draw.randrange(len(base))
        rows.append((i, " ".join([*base[:at], f"own{i}", *base[at + 1 :]])))
    rows += [(100 + i, " ".join(base)) for i in range(4)] + [(200, "a b"), (201, "A  b"), (202, "other words")]
    rows += [(r.doc_id, r.text) for r in messy.collect()]
    old, ngram_join.SALTED = ngram_join.SALTED, salted
    got = ngram_join.link_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    ngram_join.SALTED = old
    want = brute_links(rows)
    assert sum(n for _, _, n in want) > 60 * 59
    assert plain((r.doc_id, r.n_shingles, r.n_links) for r in got) == plain(want)
    assert all((r["class"] is None) == (r.n_shingles == 0) for r in got)


def test_shingles_of_the_same_groups_are_one_posting(spark):
    """Pairs of groups meet once for all shingles that the same groups have, and the counts of shared ones stay."""
    holders = {1: "abc", 2: "abc", 3: "abc", 4: "ab", 5: "ab", 6: "ac", 7: "a"}
    rows = [(t, ord(g), 100, 1, 2, cls, other) for t, own in holders.items() for g in own for cls, other in ((156, 156), (156, 157))]
    rows += [(t, ord("d"), 103, 1, 2, 157, 156) for t in (1, 2, 4)]
    side = spark.createDataFrame(rows, "token bigint, g bigint, n bigint, low bigint, high bigint, cls int, other int")
    merged = ngram_join.merged_tokens(side)

    def met(postings, same):
        left, right = (postings.select("token", *[postings[x].alias(y) for x, y in names.items()], *more) for names, more in (({"cls": "p", "other": "q", "g": "a"}, same), ({"other": "p", "cls": "q", "g": "b"}, [])))
        return left.join(right, ["token", "p", "q"]).where("a < b")

    plain, own = met(side, []).collect(), met(merged, ["times"]).collect()
    count = lambda rows, n: sorted((k, sum(n(r) for r in rows if (r.a, r.b) == k)) for k in {(r.a, r.b) for r in rows})
    assert count(plain, lambda r: 1) == count(own, lambda r: r.times)
    assert max(r.times for r in own) == 3 and len(own) < len(plain) / 1.5


def test_a_family_meets_its_outsiders_a_few_times(spark):
    """Of groups that share many shingles the first ones meet: pairs that can link at least once, all pairs less than a tenth
    as often as before."""
    import random
    from itertools import combinations

    draw, n = random.Random(8), 396
    cls = ngram_join.size_class(F.lit(n))
    least = spark.range(1).select(ngram_join.least_shared(F.lit(n), cls)).first()[0]
    sets = {g: set(draw.sample(range(60), 50)) for g in range(150)}  # a family, whose members each lack some shingles
    sets |= {150 + i: set(draw.sample(range(60), 34)) | {100 + i} for i in range(20)}  # outsiders, of which some come close
    rows = [(t, g, n, g // 150 * g, g // 150 * g) for g, own in sets.items() for t in own]
    side = spark.createDataFrame(rows, "token bigint, g bigint, n bigint, low bigint, high bigint").withColumns({"cls": cls, "other": cls})
    merged = ngram_join.merged_tokens(side)

    def met(postings):
        a, b = (postings.select("token", F.col("g").alias(x), F.col("low").alias(f"low_{x}")) for x in "ab")
        return [(r.a, r.b) for r in a.join(b, "token").where("a < b and low_a <> low_b").collect()]

    plain, own = met(merged), met(ngram_join.first_postings(merged))
    can = {(a, b) for a, b in combinations(sorted(sets), 2) if b >= 150 and len(sets[a] & sets[b]) >= least + 1}
    assert can <= set(own) <= set(plain)
    assert len(own) < len(plain) / 10


def test_outsiders_that_link_with_one_of_a_family(spark):
    import random

    draw = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    changed = lambda words, own, times: [own if i in at else w for at in [set(draw.sample(range(len(words)), times))] for i, w in enumerate(words)]
    family = [changed(base, f"own{i}", 2) for i in range(40)]
    far = [changed(base, f"far{i}", draw.randrange(3, 9)) for i in range(40)]
    rows = [(i, " ".join(words)) for i, words in enumerate([*family, *far])]
    want = brute(rows)
    assert len({c for _, _, c in want}) > 5
    assert plain(ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == plain(want)
