"""Operators 9 and 10 against brute force."""

import hashlib
import re
from collections import Counter
from math import comb

from pyspark.sql import functions as F

from galena.llm import decontaminate, quality_rules, queries
from tests.llm.conftest import SF

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base(text):
    text = text or ""
    words, seen, dup = BLANK_WORDS.findall(text), set(), 0
    for line in text.split("\n"):
        if BLANK_WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    hit = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(hit), failed


def judged(text, items):
    words, hit, names = ITEM_WORDS.findall(low(text)), set(), set()
    for name, item in items:
        own = ITEM_WORDS.findall(low(item))
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1 if windows else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def key(r):
    return tuple((x is not None, x) for x in r)


def test_op9_base_statistics(spark, small_docs):
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    got = queries.op9_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_op9_messy_rows(spark, messy):
    labels = spark.createDataFrame([(1, 1), (None, 1), (5, None), (5, 1), (99, 1)], "doc_id bigint, quality int")
    got = quality_rules.apply_rules(messy, labels).collect()
    want = [(r.doc_id, *base(r.text)) for r in messy.collect()]
    assert sorted(map(key, [tuple(r)[:7] for r in got])) == sorted(map(key, want))
    assert quality_rules.apply_rules(messy.limit(0), labels.limit(0)).count() == 0


def test_binomial_tail_is_exact(spark):
    rows = [(0, 10), (3, 50), (20, 400), (400, 400)]
    got = spark.createDataFrame(rows, "k bigint, n bigint").withColumn("p", quality_rules.binomial_at_most(F.col("k"), F.col("n"), 0.03)).collect()
    for r in got:
        assert abs(r.p - sum(comb(r.n, i) * 0.03**i * 0.97 ** (r.n - i) for i in range(r.k + 1))) < 1e-9


def shares(spark, rows):
    """rows: stratum, good, number of documents, the four statistics."""
    made = spark.createDataFrame(rows, "stratum string, good boolean, many int, symbol_share double, dup_line_share double, repeat_share double, shout_share double")
    return made.select("*", F.explode(F.sequence(F.lit(1), "many"))).drop("many", "col")


def limits_of(frame):
    return {r.stratum: tuple(r)[1:] for r in quality_rules.choose_cutoffs(frame, "stratum").collect()}


def test_cutoffs_follow_the_bad_and_keep_to_the_risk_of_the_good(spark):
    rows = []
    for lang in ("a", None):
        # Repeats tell most bad documents apart, then symbols, which half of the good ones have, too.
        rows += [(lang, True, 5000, 0.0, 0.0, 0.0, 1.0), (lang, True, 5000, 0.9, 0.0, 0.01, 1.0)]
        rows += [(lang, False, 80, 0.0, 0.0, 0.12, 0.0), (lang, False, 20, 0.9, 0.0, 0.0, 0.0)]
    assert limits_of(shares(spark, rows)) == dict.fromkeys(("a", None), (None, None, 0.1, None))
    # 0.6 % of good documents by either rule: one alone keeps to 1 %, both together do not, so the second stays loose.
    rows = [("a", True, 9880, 0.0, 0.0, 0.0, 0.0), ("a", True, 60, 0.25, 0.0, 0.0, 0.0), ("a", True, 60, 0.0, 0.25, 0.0, 0.0), ("a", False, 9, 0.25, 0.0, 0.0, 0.0), ("a", False, 8, 0.0, 0.25, 0.0, 0.0)]
    assert limits_of(shares(spark, rows)) == {"a": (0.2, 0.3, None, None)}
    # Cutoffs grow stricter along the path up to the first that is not allowed.
    rows = [("a", True, 1000, 0.0, 0.0, 0.0, 0.0), ("a", True, 100, 0.12, 0.0, 0.0, 0.0), ("a", False, 9, 0.04, 0.0, 0.0, 0.0), ("a", False, 1, 0.9, 0.0, 0.0, 0.0)]
    assert limits_of(shares(spark, rows)) == {"a": (0.15, None, None, None)}


def test_least_labels_and_the_pooled_stratum(spark):
    bad = lambda lang: (lang, False, 5, 0.9, 0.0, 0.0, 0.0)
    good = lambda lang, n: (lang, True, n, 0.0, 0.0, 0.0, 0.0)
    found, none = (0.5, None, None, None), (None,) * 4
    least = quality_rules.least_labels(1)
    assert limits_of(shares(spark, [good("a", least), bad("a")])) == {"a": found}
    assert limits_of(shares(spark, [good("a", least - 1), bad("a")])) == {"a": none}
    assert limits_of(shares(spark, [good("a", 200), good("b", 200), bad("a")])) == {"a": found, "b": found}
    own = quality_rules.least_labels(3)
    # Two small strata have too few labels together, so the third joins them; a fourth stratum stays by itself.
    assert limits_of(shares(spark, [good("a", own), good("b", 9), good(None, 9), bad("b")])) == {"a": found, "b": found, None: found}
    own = quality_rules.least_labels(4)
    rows = [good("a", own), good("c", own + 1), good("b", 9), good(None, 9)]
    assert limits_of(shares(spark, [*rows, bad("b")])) == {"a": found, "c": none, "b": found, None: found}
    assert limits_of(shares(spark, [*rows, bad("c")])) == {"a": none, "c": found, "b": none, None: none}
    assert limits_of(shares(spark, [good("a", least)])) == {"a": none}
    assert limits_of(shares(spark, [bad("a")])) == {}


def test_rules_act_on_the_given_tables(spark):
    got = queries.op9_quality_rules(spark, "/root/testdata/sf0.01")
    assert 0 < got.where("not kept and not base_failed").count() < 100


def test_long_binomial_sums_are_exact(spark):
    """Sums from the last term down, against plain sums of logarithms in full precision."""
    from math import exp, fsum, lgamma, log

    def tail(k, n, p):
        top = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(max(0, k - 60_000), k + 1)]
        return fsum(map(exp, top))

    rows = [(1001, 110_000), (1100, 110_000), (9_900, 1_000_000), (99_000, 10_000_000), (1_000, 100_000), (5_000, 400_000)]
    got = spark.createDataFrame(rows, "k bigint, n bigint").withColumn("p", quality_rules.binomial_at_most(F.col("k"), F.col("n"), 0.01)).collect()
    for r in got:
        want = tail(r.k, r.n, 0.01) if r.k <= r.n * 0.01 else 1.0
        assert abs(r.p - want) <= 1e-6 * want, (r, want)
    # Beyond what plain sums can hold: the tail at the mean is about a half, and the central limit theorem holds three deviations below.
    huge = [(10**10, 10**12), (10**10 - 298_496, 10**12)]
    mid, low = [r.p for r in spark.createDataFrame(huge, "k bigint, n bigint").select(quality_rules.binomial_at_most(F.col("k"), F.col("n"), 0.01).alias("p")).collect()]
    assert abs(mid - 0.5) < 1e-4 and abs(low / 0.0013499 - 1) < 1e-3


def test_cutoffs_at_a_thousand_labels(spark):
    # 1,000 good labels in each of two strata, none with symbols, junk of about a half: told apart without error.
    good = [(2 * i + j, lang, "") for i in range(1000) for j, lang in enumerate(("a", "b"))]
    junk = [(10_000 + i, "a", " ".join(f"w{k}" for k in range(40)) + " " + "#" * 100) for i in range(50)]
    few = [(20_000, "c", junk[0][2]), (20_001, "c", "one word"), (20_002, "d", junk[0][2])]
    docs = [(k, lang, text or " ".join(f"{lang}{(k * 7 + m) % 99991}" for m in range(30))) for k, lang, text in good + junk + few]
    labels = [(k, 1) for k, _, _ in good] + [(k, 0) for k, _, _ in junk] + [(20_001, 1)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(docs, "doc_id bigint, lang string, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert all(got[k].kept for k, _, _ in good)
    assert not any(got[k].kept or got[k].base_failed for k, _, _ in junk)
    assert not got[20_000].kept  # one good label: judged with the smallest stratum that has enough
    assert got[20_002].kept  # a stratum without labels has no cutoff


def test_op10_against_brute_force(spark, small_docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    got = queries.op10_decontamination(spark, SF).collect()
    assert len(got) == len(texts) and any(r.contaminated for r in got)
    for r in got:
        assert tuple(r)[1:] == judged(texts[r.doc_id], items), r.doc_id


def test_op10_messy_rows_short_and_periodic_items(spark, messy):
    items = [(1, "ipsum DOLOR lorem"), (2, "lorem ipsum dolor " * 6), (2, "text of"), (7, None), (8, "--"), (10, "no key at all endoftext it s"), (11, "same text twice here now"), (11, "same text twice here now")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for small in (200_000, 0):
        decontaminate.SMALL_WINDOWS = small
        got = decontaminate.decontaminate(messy, bench).collect()
        want = [(r.doc_id, *judged(r.text, [(a, b or "") for a, b in items])) for r in messy.collect()]
        assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    decontaminate.SMALL_WINDOWS = 200_000
    assert decontaminate.decontaminate(messy.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(messy, bench.limit(0)).collect())


def test_fingerprints_carry_words_and_hash_no_whole_spans(spark):
    """Runs of windows by their least gram, with the words that their spans are made of; spans are hashed after the join."""
    import random

    from pyspark.sql import functions as F

    from galena.llm.exprs import least_of

    rand = random.Random(3)
    lists = [[rand.randrange(50) for _ in range(n)] for n in (0, 1, 8, 9, 10, 40)]
    rows = spark.createDataFrame([(x,) for x in lists], "h array<bigint>")
    for size in (1, 5, 9):
        assert [r.m for r in rows.select(least_of(F.col("h"), size).alias("m")).collect()] == [[min(x[i : i + size]) for i in range(len(x) - size + 1)] for x in lists]
    for x, r in zip(lists, rows.select(decontaminate.fingerprints(F.col("h"), 9, 3).alias("f")).collect(), strict=True):
        starts = [f.start for f in r.f] + [len(x) - 9 + 2]
        assert [f.h for f in r.f] == [x[a - 1 : b - 1 + 8] for a, b in zip(starts, starts[1:], strict=False)]
        assert (starts[0] == 1) == (len(x) >= 9) or not r.f
