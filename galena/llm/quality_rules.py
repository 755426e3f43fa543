"""Quality rules with risk-controlled thresholds, by DataFrame functions only.

Each rule rejects a document whose statistic exceeds a cutoff. Cutoffs are chosen for each stratum on labelled documents
by exact binomial tests of "the rules turn away more than the allowed share of good documents":

1. Documents labelled bad lay down a path of ever stricter policies: the rule that tells most of them apart comes first,
   from the loosest cutoff down to the loosest that catches all that it can; then the next rule joins in, and so on.
2. Documents labelled good test the policies along the path, each as a whole at the whole risk, until the first that is
   not allowed (fixed-sequence testing). As the path does not depend on good documents, policies do not share delta;
   only strata do (Bonferroni). With probability 1 - delta all strata keep to the risk at once.

Strata with too few good labels to get any cutoff (see `least_labels`) are tested together, as one pooled stratum, whose
risk is controlled as a whole; if they have too few together, the next smallest strata join them until there are enough.
If all strata together have too few, or a stratum no labels at all, nothing of it is rejected by rules.
"""

from __future__ import annotations

from math import ceil, log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.exprs import BLANKS, covered, grams, let, words
from galena.llm.shared import written

#: The rules' statistics, all shares of 0 to 1, and the cutoffs that are tried for each.
RULES = ("symbol_share", "dup_line_share", "repeat_share", "shout_share")
CUTOFFS = (0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)
#: Terms of a binomial sum that are added from the first one up; longer sums go from the last one down.
UP_TERMS = 1_000
#: Strata up to this number are broadcast; beyond it the join is left to Spark.
SMALL_STRATA = 10_000
WINDOW = 8
#: The share of good documents that rules may turn away, and the chance that they turn away more.
RISK, DELTA = 0.01, 0.05


def repeated_words(tokens: Column) -> Column:
    """Words in windows of 8 words that are found twice or more in the text, the first one included.

    Windows are compared by 64-bit hashes of word hashes; only texts with an equal pair are looked at further.
    """

    def places(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

        def twice(o: Column) -> Column:
            near = lambda x, k: F.get(o, k)["g"] == x["g"]
            return F.filter(o, lambda x, k: ((k > 0) & near(x, F.greatest(k - 1, F.lit(0)))) | F.coalesce(near(x, k + 1), F.lit(False)))

        spans = let(ordered, lambda o: F.transform(twice(o), lambda x: F.struct(x["i"].alias("start"), F.lit(WINDOW).alias("len"))))
        return covered(spans)

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(grams(h, WINDOW), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), places(g)).otherwise(0)))


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds struct `stats` with the base statistics and the rules' shares of each whole text (null: no words)."""
    own = F.coalesce(F.col(text), F.lit(""))
    base = let(
        words(own),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.when(F.size(w) > WINDOW, repeated_words(w)).otherwise(0).cast("bigint").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.rlike("!!|^\\p{Lu}{2,}\\W*$"))).alias("n_shouts"),
        ),
    )
    lines = F.filter(F.split(own, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))
    symbols = (F.length(own) - F.length(F.regexp_replace(own, "[#*$%&|<>]+", ""))).cast("bigint")
    return df.withColumn("stats", F.struct(base.alias("w"), by_line.alias("l"), symbols.alias("n_symbols")))


def shares() -> list[Column]:
    """The rules' statistics from `stats`; 0 where there is nothing to take a share of."""
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    w, line = F.col("stats.w"), F.col("stats.l")
    return [
        part(F.col("stats.n_symbols"), w["word_chars"]).alias("symbol_share"),
        part(line["dup"], line["n"]).alias("dup_line_share"),
        part(w["n_repeat_words"], w["n_words"]).alias("repeat_share"),
        part(w["n_shouts"], w["n_words"]).alias("shout_share"),
    ]


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Binomial(n, p), 0 <= k <= n, at any size.

    Up to UP_TERMS terms are added, each from the one before, in logarithms. Longer sums are taken from term k down, for k
    up to the mean, where terms fall at least as fast as exp(-j^2 / (2 n p)): after 10 standard deviations the rest is
    less than 1e-20 of the sum. Term k itself comes from the saddle point, without the cancelling of large factorials.
    Above the mean (k > n p) long sums are no concern of a test and give 1.
    """
    step = F.log(F.lit(p / (1 - p)))
    first = n.cast("double") * F.log(F.lit(1 - p))
    zero = F.struct(first.alias("term"), first.alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1).cast("double") / i.cast("double")) + step
        top = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["sum"] - top) + F.exp(term - top))).alias("sum"))

    none = F.array().cast("array<bigint>")
    terms = F.when((k >= 1) & (k <= UP_TERMS), F.sequence(F.lit(1).cast("bigint"), k)).otherwise(none)
    up = F.exp(F.aggregate(terms, zero, add, lambda a: a["sum"]))

    mean = n.cast("double") * p
    reach = F.least(k, F.ceil(10 * F.sqrt(mean)) + 50).cast("bigint")
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def below(a: Column, j: Column) -> Column:
        term = a["term"] * ((k - j + 1).cast("double") / (n - k + j).cast("double")) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    under = F.when((k > UP_TERMS) & (k <= mean), F.sequence(F.lit(1).cast("bigint"), reach)).otherwise(none)
    down = F.exp(log_term(k, n, p) + F.log(F.aggregate(under, one, below, lambda a: a["sum"])))
    return F.when(k <= UP_TERMS, up).when(k > mean, 1.0).otherwise(down)


def log_term(k: Column, n: Column, p: float) -> Column:
    """The logarithm of P(X = k) for X of Binomial(n, p), for 0 < k < n both well above 1, by Stirling's series around the
    saddle point: the deviance of k and n - k from their means, and what the series leaves of three factorials."""
    left = n - k
    rest = lambda x: F.pow(12.0 * x, F.lit(-1)) - F.pow(360.0 * F.pow(x, F.lit(3)), F.lit(-1))
    away = lambda x, m: x * F.log1p((x - m) / m)
    deviance = away(k, n * p) + away(left, n * (1 - p))
    size = F.log(k / n) + F.log(left.cast("double")) + log(2 * pi)
    return rest(n) - rest(k) - rest(left) - deviance - size / 2


def least_labels(strata: int, risk: float = RISK, delta: float = DELTA) -> int:
    """Good labels that a stratum needs to get any cutoff, if the rules turn away none of them."""
    return ceil(log(delta / strata) / log(1 - risk))


def over(limits: list[Column]) -> Column:
    """Whether any rule's statistic exceeds its cutoff; cutoffs in the rules' order, null for none."""
    a, b, c, d = [F.coalesce(F.col(r) > x, F.lit(False)) for r, x in zip(RULES, limits, strict=True)]
    return a | b | c | d


def levels() -> list[Column]:
    """How many of the cutoffs each statistic exceeds."""
    level = lambda r: F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: F.col(r) > c))
    return [level(r).alias(f"level_{r}") for r in RULES]


def parts_of(good: DataFrame, stratum: str, risk: float, delta: float) -> DataFrame:
    """stratum, part, level: which part each stratum with good labels is tested in ('*': pooled), and its share of delta.

    Strata of too few labels are pooled, with the next smallest ones (ties: by name) while the pool has too few itself.
    The windows are over a row for each stratum.
    """
    every = Window.partitionBy()
    smaller = every.orderBy("n", F.col(stratum).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    n = good.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).withColumn("strata", F.count(F.lit(1)).over(every))
    n = n.withColumn("before", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    least = F.ceil(F.log(delta / F.col("strata")) / F.log(F.lit(1 - risk)))
    own = (F.col("n") >= least) & ((F.col("before") == 0) | (F.col("before") >= least))
    name = F.when(~own, "*").when(F.col(stratum).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(stratum).cast("string")))
    parted = n.withColumn("part", name)
    return parted.select(stratum, "part", (F.lit(delta) / F.size(F.collect_set("part").over(every))).alias("level"))


def policies(bad: DataFrame) -> DataFrame:
    """part, step, limits: the path of each part, from its bad documents. bad: part, level_ columns, n (documents).

    limits has a number for each rule: levels above it are turned away. The last level is exceeded by none.
    """
    none = len(CUTOFFS)
    each = F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"level_{r}").alias("level")) for i, r in enumerate(RULES)])
    caught = bad.select("part", "n", F.explode(each).alias("x")).select("part", "n", "x.*").where("level > 0").groupBy("part", "rule", "level").agg(F.sum("n").alias("n"))
    # The least level among a rule's caught documents gives the loosest cutoff that catches all that the rule can.
    best = caught.groupBy("part", "rule").agg(F.sum("n").alias("caught"), (F.min("level") - 1).alias("limit"))
    order = Window.partitionBy("part").orderBy(F.desc("caught"), "rule")  # at most a row for each rule
    best = best.withColumn("place", F.row_number().over(order))
    together = best.groupBy("part").agg(F.collect_list(F.struct("place", "rule", "limit")).alias("chain"))
    turn = together.select("part", "chain", F.explode("chain").alias("own"))
    turn = turn.select("part", "chain", "own", F.explode(F.sequence(F.lit(none - 1), F.col("own.limit"), F.lit(-1))).alias("at"))
    before = lambda q: F.filter("chain", lambda c: (c["rule"] == q) & (c["place"] < F.col("own.place")))
    limit = lambda q: F.when(F.col("own.rule") == q, F.col("at")).otherwise(F.coalesce(F.get(before(q), F.lit(0))["limit"], F.lit(none)))
    step = F.col("own.place") * none + (none - F.col("at"))
    return turn.select("part", step.alias("step"), F.array(*map(limit, range(len(RULES)))).alias("limits"))


def choose_cutoffs(labelled: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """max_<rule> for each stratum with good labels (null is a stratum), null where the rule has no cutoff.

    labelled: the stratum column, good (boolean) and a column for each of RULES. What is joined are counts by levels of
    the grid, so nothing here grows with the documents but the first aggregate.
    """
    parts = parts_of(labelled.where("good"), stratum, risk, delta)
    named = parts.withColumnRenamed(stratum, "of")
    level_names = [f"level_{r}" for r in RULES]
    cells = labelled.select(stratum, "good", *levels()).groupBy(stratum, "good", *level_names).agg(F.count(F.lit(1)).alias("n"))
    cells = written(cells.join(named, F.col(stratum).eqNullSafe(F.col("of"))).groupBy("part", "level", "good", *level_names).agg(F.sum("n").alias("n")), "quality-levels")
    path = policies(cells.where("not good"))
    away = [F.col(c) > F.get("limits", F.lit(i)) for i, c in enumerate(level_names)]
    tried = path.join(cells.where("good"), "part").groupBy("part", "step", "limits", "level")
    tried = tried.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(away[0] | away[1] | away[2] | away[3], F.col("n"))), F.lit(0)).alias("k"))
    # At the mean and above the tail is over a third, and the test of no use.
    tail = F.when(F.col("k") > F.col("n") * risk, 1.0).otherwise(binomial_at_most(F.col("k"), F.col("n"), risk))
    failed = F.min(F.when(tail > F.col("level"), F.col("step")))
    first = Window.partitionBy("part")
    allowed = tried.withColumn("failed", failed.over(first)).where(F.col("failed").isNull() | (F.col("step") < F.col("failed")))
    chosen = allowed.groupBy("part").agg(F.max_by("limits", "step").alias("limits"))
    cutoffs = F.array(*map(F.lit, CUTOFFS))
    own = [F.get(cutoffs, F.get("limits", F.lit(i))).alias(f"max_{r}") for i, r in enumerate(RULES)]
    return parts.join(chosen, "part", "left").select(stratum, *own)


def apply_rules(df: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text", good: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per row of df: key, the base statistics, base_failed and kept.

    labels has key and good (1: good, 0: bad); rows of it with nulls, or without a document, say nothing; a key labelled
    twice counts twice. risk: the share of a stratum's good documents that rules may turn away; delta: the chance that
    any stratum's cutoffs break that. base_failed: fewer than 20 words, or over 30 % of words in repeated windows. kept:
    not base_failed and no rule of the row's stratum exceeded. Other columns of df are not looked at.
    """
    stats = statistics(df.select(F.col(key).alias("key"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))).drop("text")
    seen = written(stats.select("key", "stratum", "stats.w.*", F.col("stats.l.dup").alias("n_dup_lines"), "stats.n_symbols", *shares()), "quality-stats")
    known = labels.where(F.col(good).isin(0, 1)).select(F.col(key).alias("key"), (F.col(good) == 1).alias("good"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    labelled = seen.join(known, "key").where(F.col("good") | ~failed)  # rules have to find what the base checks leave
    cutoffs = written(choose_cutoffs(labelled.select("stratum", "good", *RULES), "stratum", risk, delta), "quality-cutoffs")
    limits = cutoffs.withColumnRenamed("stratum", "of")
    limits = F.broadcast(limits) if cutoffs.count() <= SMALL_STRATA else limits
    both = seen.join(limits, F.col("stratum").eqNullSafe(F.col("of")), "left")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return both.select(F.col("key").alias(key), *base, failed.alias("base_failed"), (~failed & ~over([F.col(f"max_{r}") for r in RULES])).alias("kept"))
