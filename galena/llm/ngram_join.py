"""Similarity join of documents by the Jaccard measure of their word n-grams: a grouped prefix join.

Steps, each a Spark job whose result is written:

1. frequent: all shingles are counted, and the most frequent are listed. That list (of bounded length) fixes one order of
   all shingles: those that are not on it first, then the rarer ones first, ties by hash. Any order gives the same links; this one keeps
   common passages out of the prefixes.
2. sets: documents with equal sets are one node. A set's prefix is its first n - ceil(t n) + 1 shingles: two sets that
   link share a shingle of their prefixes. Nodes with equal prefix and size are one group.
3. Groups that share prefix shingles are paired. In the join itself, parities of the whole sets' hashes over BITS bits
   tell the least that two sets differ in, and pairs that differ in too much make no row. A pair's count of shared prefix
   shingles then bounds its overlap; the rest is expanded to nodes and verified on whole sets.

`similarity_links` gives every link. Where only components are asked for (`similarity_components`), pairs of nodes that are
known to be connected are skipped: in a few rounds each group is paired with a few hubs of other components (a number of
pairs in proportion to the groups; hubs change with the round), then all pairs that lie in different components so far are
compared. Before that, groups are dropped that cannot link beyond their component, as they share too few prefix shingles
with all groups of a class of sizes taken together: a table of postings by size class tells it, without pairs. Shingles that
the same groups are left with are one posting then, so that a pair meets once for all of them. Of what a group is left with,
the first shingles meet, rarest first, as those behind them are too few for a link. So within a family of near copies the
pairs are in proportion to its size, and no link between components is lost; its pairs with texts just outside it, as far as
all these bounds leave them possible, are not.

Shingles are 64-bit hashes of hashes of words, and nodes are 64-bit hashes of sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.components import components
from galena.llm.shared import batches, give_back, small_batches, tidy, written

WIDTH = 5
#: Similarity as a fraction: two sets link if TIMES the intersection's size is at least LEAST times the union's.
TIMES, LEAST = 100, 75
#: Shingles that a task holds at once, and that a range of hashes has on average; the sets that make a shingle frequent,
#: how many frequent ones are kept (16 bytes each; they are broadcast), and the count beyond which only powers of two are told apart. They order shingles and decide nothing else.
CHUNK, RANGE, FREQUENT, KEPT, MOST = 1_000_000, 500_000, 3, 600_000, 10_000
#: Bits of a set's parities, as columns of 64 bits.
BITS = 512
PARITIES = [f"b{i}" for i in range(BITS // 64)]
#: Sizes of one class differ by this factor at most.
CLASS = 1.03
#: Rounds in which groups are linked with hubs before all pairs across components are compared, and hubs a round.
ROUNDS, HUBS = 2, 3
#: Bytes of text that are hashed together, and those of a longer text's part.
TOGETHER, PART = 1 << 17, 1 << 20
#: Groups of one token that a task pairs at once: tokens of more are split.
SALTED = 500


#: Values of bytes in a hash: random, but alike for A-Z and a-z and for all blanks.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
VALUES[65:91], VALUES[BLANK] = VALUES[97:123], VALUES[32]
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=8)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of BASE and of its inverse modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n + 1, np.uint64(base), np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def hashed_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's 5-word shingles; with fewer words, of all its words; none without words.

    Words are parted by [ \\t-\\r]; a shingle's hash is the polynomial of its bytes, A-Z lower-cased and one blank between
    words. All texts are looked at in one go, so they are to be short together.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = BLANK[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at = np.cumsum(keep)  # place of each byte in what is kept, plus one
    blank, value = blank[keep], VALUES[raw[keep]]
    size = 1 << max(16, len(value).bit_length())
    up, down = powers(size)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * up[: len(value)], out=total[1:])
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edge = edge if blank[0] else np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]  # the last byte is a blank, so every word ends

    def mixed(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        x = (total[z] - total[a]) * down[a]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    wide = mixed(start[: 1 - WIDTH], end[WIDTH - 1 :]) if len(start) >= WIDTH else np.empty(0, np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(start, at[ends - 1] - 1).tolist()
    out, first = [], 0
    for stop in last:
        n = stop - first
        if n >= WIDTH:
            own = np.sort(wide[first : stop - WIDTH + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        else:
            out.append(mixed(start[first : first + 1], end[stop - 1 : stop]) if n else np.empty(0, np.uint64))
        first = stop
    return out


def long_set(text: bytes) -> np.ndarray:
    """What hashed_sets gives for one text, by parts of about PART bytes: each starts with the last four words before it."""
    found, at, carry = [], 0, b""
    while at < len(text):
        end = at + PART
        while end < len(text) and not BLANK[text[end]]:
            end += 1
        part = carry + text[at:end]
        if len(part.split(maxsplit=WIDTH - 1)) >= WIDTH:
            found.append(hashed_sets([part])[0])
        carry, at = b" ".join(part.rsplit(maxsplit=WIDTH - 1)[1 - WIDTH :]) + b" ", end
    return np.unique(np.concatenate(found)) if found else hashed_sets([carry])[0]


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """hashed_sets of any number of texts of any length (null: no words), one after the other."""
    held, size = [], 0
    for text in texts:
        text = text or b""
        if len(text) > PART:
            yield from hashed_sets(held) if held else ()
            held, size = [], 0
            yield long_set(text)
            continue
        held.append(text)
        size += len(text)
        if size > TOGETHER:
            yield from hashed_sets(held)
            held, size = [], 0
    if held:
        yield from hashed_sets(held)


def shingles(text: bytes | None) -> np.ndarray:
    return next(shingle_sets([text]))


def prefix_length(n: int) -> int:
    """n - ceil(t n) + 1"""
    return n - -(-LEAST * n // TIMES) + 1 if n else 0


def frequent_shingles(docs: DataFrame) -> DataFrame:
    """hash, count of the KEPT most frequent shingles of all documents, of those that FREQUENT sets or more have.

    Every shingle is counted. So that the whole of them stays small in the shuffle, chunks send sorted arrays of 32 bits
    a shingle, one for each range of hashes; there are so many ranges that one is merged in little memory. Hashes are
    told apart by range and those bits: at worst two shingles share a count, and with it their place in the order.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(total / 5 / RANGE).bit_length())

    def send(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def packed(held: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held)) >> np.uint64(32 - bits)
            edges = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
            low = keys.astype(np.uint32)
            parts = [(i, low[x:y].tobytes()) for i, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if y > x]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["range", "hashes"])

        for b in batches(frames):
            for s in shingle_sets(b.column("text").cast(pa.binary()).to_pylist()):
                digest = hashlib.blake2b(s.tobytes(), digest_size=12).digest()
                if digest not in seen:  # equal sets are one node later on
                    seen.add(digest)
                    held.append(s)
                    size += len(s)
            if size > CHUNK:
                yield packed(held)
                held, size, seen = [], 0, set()
        if size:
            yield packed(held)
        del held, seen
        give_back()

    def count(key, group):
        parts = [np.frombuffer(x, np.uint32) for x in group.column("hashes").to_pylist()]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        many = counts >= FREQUENT
        keys = (np.uint64(key[0].as_py()) << np.uint64(32)) | values[many].astype(np.uint64)
        return pa.table({"hash": keys.view(np.int64), "count": counts[many].astype(np.int64)})

    counted = docs.select("text").mapInArrow(send, "range int, hashes binary").groupBy("range").applyInArrow(count, "hash bigint, count bigint")
    counted = written(counted, "shingle-counts")
    # The least count that KEPT shingles or fewer reach, from how many shingles there are of each count.
    rough = F.when(F.col("count") <= MOST, F.col("count")).otherwise(MOST * F.pow(F.lit(2.0), F.floor(F.log2(F.col("count") / MOST))).cast("bigint"))
    by_count = counted.groupBy(rough.alias("count")).agg(F.count(F.lit(1)).alias("many")).collect()  # MOST + 64 rows
    least, room = 1 << 62, KEPT
    for r in sorted(by_count, key=lambda r: -r["count"]):
        room -= r["many"]
        if room < 0:
            break
        least = r["count"]
    return counted.where(F.col("count") >= least).select("hash", "count", F.lit(bits).alias("bits"))


def ordered_sets(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """key, n, node, prefix (packed hashes), group and parities for each document; all but key and n are null for empty sets."""
    rows = frequent.toArrow()  # KEPT rows at most
    hashes, counts, own_bits = (rows.column(c).to_numpy() for c in ("hash", "count", "bits"))
    bits, order = int(own_bits.max()) if len(rows) else 4, np.argsort(hashes.astype(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast((hashes.astype(np.uint64)[order], counts.astype(np.int64)[order]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for b in batches(frames):
            sizes, nodes, prefixes, groups, bits_ = [], [], [], [], []
            for s in shingle_sets(b.column("text").cast(pa.binary()).to_pylist()):
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None), prefixes.append(None), groups.append(None), bits_.append(None)
                    continue
                if len(known):
                    own = s >> np.uint64(32 - bits)
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    s_count = np.where(known[at] == own, counts[at], 0)
                    first = s[np.argsort(s_count, kind="stable")[: prefix_length(len(s))]]
                else:
                    first = s[: prefix_length(len(s))]
                packed = first.tobytes()
                nodes.append(to_id(s.tobytes()))
                prefixes.append(packed)
                groups.append(to_id(packed + len(s).to_bytes(8, "little")))
                bits_.append(parities(s))
            columns = [b.column("key"), *(pa.array(x, pa.int64()) for x in (sizes, nodes, groups)), pa.array(prefixes, pa.binary())]
            each = [pa.array([None if x is None else int(x[i]) for x in bits_], pa.int64()) for i in range(len(PARITIES))]
            yield pa.RecordBatch.from_arrays([*columns, *each], names=["key", "n", "node", "grp", "prefix", *PARITIES])

    return docs.mapInArrow(run, "key bigint, n bigint, node bigint, grp bigint, prefix binary, " + ", ".join(f"{c} bigint" for c in PARITIES))


def parities(s: np.ndarray) -> np.ndarray:
    """For each of BITS classes of hashes whether an odd number of the set's is in it, packed to 64-bit integers."""
    odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def near_enough(n_a: Column, n_b: Column, suffix: str) -> Column:
    """Whether the parities, columns of either side (the other's with a suffix), leave room for a link: each bit that
    differs is a shingle that one set has and the other has not. Null parities leave it open."""
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + suffix))) for c in PARITIES[1:]), F.bit_count(F.col(PARITIES[0]).bitwiseXOR(F.col(PARITIES[0] + suffix))))
    return F.coalesce(apart <= n_a + n_b - 2 * F.ceil(LEAST * (n_a + n_b) / F.lit(TIMES + LEAST)), F.lit(True))


def group_parities(nodes: DataFrame, name: str) -> DataFrame:
    """The parities of groups of one set, null for others. name: of the group's column."""
    own = [F.when(F.count(F.lit(1)) == 1, F.min(c)).alias(c) for c in PARITIES]
    return nodes.groupBy(F.col("grp").alias(name)).agg(*own)


def to_id(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def unpack_tokens(groups: DataFrame) -> DataFrame:
    """token, grp, n for every prefix shingle of every group."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            prefixes = b.column("prefix").to_pylist()
            sizes = np.array([len(p) // 8 for p in prefixes])
            tokens = np.frombuffer(b"".join(prefixes), np.int64)
            cols = [tokens, *(np.repeat(b.column(c).to_numpy(), sizes) for c in ("grp", "n"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "grp", "n"])

    return groups.mapInArrow(run, "token bigint, grp bigint, n bigint")


def may_link(n_a: Column, n_b: Column) -> Column:
    return TIMES * F.least(n_a, n_b) >= LEAST * F.greatest(n_a, n_b)


def enough_shared(count: Column, n_a: Column, n_b: Column) -> Column:
    """Whether so many shared prefix shingles leave room for the overlap that a link takes.

    Of the set whose prefix ends first in the order, all common shingles in that prefix lie in the other prefix as well,
    so the overlap is at most the count plus what that set has beyond its prefix; the larger remainder bounds both.
    """
    rest = lambda n: F.ceil(LEAST * n / TIMES) - 1
    least = F.ceil(LEAST * (n_a + n_b) / F.lit(TIMES + LEAST))
    return count + F.greatest(rest(n_a), rest(n_b)) >= least


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(CLASS))).cast("int")


def least_shared(n: Column, cls: Column) -> Column:
    """The fewest shared prefix shingles with which a set of n can link with a set of the size class: the least that
    enough_shared takes over the sizes of the class (with room for the rounding of its limits)."""
    below, above = F.floor(F.pow(F.lit(CLASS), cls)), F.ceil(F.pow(F.lit(CLASS), cls + 1))
    need = lambda m: (n + m) * (LEAST / (TIMES + LEAST)) - F.ceil(LEAST * F.greatest(n, m) / TIMES) + 1
    return F.greatest(F.lit(1.0), F.least(need(F.greatest(below, F.lit(1))), need(above)) - 1)


def open_postings(side: DataFrame) -> DataFrame:
    """token, g, n, low, high, cls, other: the postings (token, g, n, and the components that g spans: low to high) that
    can be part of a link with a group of size class `other` in another component.

    A group's count of shingles that any group of that class beyond its component has bounds what it shares with each.
    Twice over, the second time among what the first leaves. Rows are postings by size classes, never pairs.
    """
    own = side.withColumn("cls", size_class(F.col("n")))
    least, most = size_class(F.ceil(LEAST * F.col("n") / TIMES)) - 1, size_class(F.floor(TIMES * F.col("n") / LEAST)) + 1
    beyond = (F.col("low") != F.col("low_")) | (F.col("high") != F.col("high_")) | (F.col("low") != F.col("high"))
    there = own.groupBy("token", F.col("cls").alias("other")).agg(F.min("low").alias("low_"), F.max("high").alias("high_"))
    met = own.join(there, "token").where(F.col("other").between(least, most) & beyond).drop("low_", "high_")
    for turn in range(2):
        met = written(met, "met-postings")
        alive = met.groupBy("g", "n", "other").agg(F.count(F.lit(1)).alias("same")).where(F.col("same") >= least_shared(F.col("n"), F.col("other"))).select("g", "other")
        met = met.join(alive, ["g", "other"])
        if not turn:
            met = written(met, "met-postings")
            there = met.groupBy("token", F.col("cls").alias("other"), F.col("other").alias("cls")).agg(F.min("low").alias("low_"), F.max("high").alias("high_"))
            met = met.join(there, ["token", "other", "cls"]).where(beyond).drop("low_", "high_")
    return written(met, "open-postings")


def merged_tokens(side: DataFrame) -> DataFrame:
    """The postings with one token for all tokens that the same groups have, and how many these are (times).

    Within two size classes, near copies share most of their shingles; these stand in one posting then, so that a pair of
    groups meets once for all of them. Alike lists of groups are told by two hashes of 64 bits and their length.
    """
    at = ["token", "cls_", "other_"]
    own = side.withColumns({"cls_": F.least("cls", "other"), "other_": F.greatest("cls", "other")})
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "g", "cls", "other")).alias(f"mark{i}") for i in range(2)]
    lists = own.groupBy(*at).agg(*marks, F.count(F.lit(1)).alias("many"))
    each = own.join(lists.where("many > 1"), at)  # a list of one group pairs with nothing
    merged = each.groupBy("mark0", "mark1", "many", "g", "n", "low", "high", "cls", "other").agg(F.count(F.lit(1)).alias("times"))
    return written(merged.select(F.struct("mark0", "mark1", "many").alias("token"), "g", "n", "low", "high", "cls", "other", "times"), "merged-postings")


def first_postings(merged: DataFrame) -> DataFrame:
    """The merged postings in which groups that can link meet first, and how many shingles of its own a group has from each
    on (rest).

    A group's postings towards a size class are put in one order for all groups, those of fewest groups first. What two
    groups share lies at their first common posting or behind it, so that one has as many shingles behind it as a link takes;
    postings with fewer are left out, which keeps a pair's first one.
    """
    own = Window.partitionBy("g", "other").orderBy(F.desc("token.many"), F.desc("token"))
    known = merged.withColumn("rest", F.sum("times").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return known.where(F.col("rest") >= least_shared(F.col("n"), F.col("other")))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b: nodes) that link by their whole sets. nodes: node, key of a document that has the set."""
    pairs = written(pairs.distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    keys = nodes.join(needed, "node", "left_semi").select("key").distinct()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            sets = [s.tobytes() for s in shingle_sets(b.column("text").cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([to_id(s) for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    found = docs.join(keys, "key", "left_semi").mapInArrow(run, "node bigint, set binary")
    sets = written(found.join(needed, "node", "left_semi"), "sets")

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            keep = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
                both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(TIMES * same >= LEAST * (len(both) - same))
            yield b.select(["a", "b"]).filter(pa.array(keep))

    of = lambda side: sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}"))
    return written(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(check, "a bigint, b bigint").distinct(), "links")


def prepared(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs (key, text, of), sets (one a row of df), nodes, and tokens (token, grp, n, many: the token's groups) that
    several groups have."""
    own = df.select(F.col(key).cast("bigint").alias("of"), F.col(text).alias("text"))
    # With a constant, as the plain hash of a null text is 42, which may be a key.
    docs = own.select(F.coalesce("of", F.xxhash64("text", F.lit("no key"))).alias("key"), "text", "of")
    frequent = written(frequent_shingles(docs), "frequent")
    sets = written(ordered_sets(docs.select("key", "text"), frequent), "sets")
    full = sets.where("node is not null")
    nodes = written(full.groupBy("node").agg(F.min("key").alias("key"), F.min("grp").alias("grp"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in PARITIES]), "nodes")
    # One document's row brings a group's prefix along, so that prefixes are shuffled once a group.
    chosen = nodes.groupBy("grp").agg(F.min(F.struct("node", "key")).alias("c")).select("grp", "c.node", "c.key")
    groups = full.join(chosen, ["grp", "node", "key"], "left_semi").dropDuplicates(["grp"]).select("grp", "n", "prefix")
    postings = unpack_tokens(groups)
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    tokens = written(postings.join(shared, "token"), "postings")
    return docs, sets, nodes, tokens


def group_pairs(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """g, k: every pair of groups whose shared prefix shingles leave room for a link.

    The groups of a token are dealt to parts of about SALTED by hash, and each part meets all of them in a task of its own.
    """
    parts = F.ceil(F.col("many") / SALTED).cast("int")
    known = tokens.join(group_parities(nodes, "grp"), "grp")
    own = known.select("token", F.pmod(F.xxhash64("grp"), parts).cast("int").alias("part"), F.col("grp").alias("g"), F.col("n").alias("gn"), *PARITIES)
    other = known.select("token", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("grp").alias("k"), F.col("n").alias("kn"), *[F.col(c).alias(c + "_") for c in PARITIES])
    near = may_link(F.col("gn"), F.col("kn")) & near_enough(F.col("gn"), F.col("kn"), "_")
    met = own.join(other, ["token", "part"]).where((F.col("g") < F.col("k")) & near)
    met = met.groupBy("g", "gn", "k", "kn").agg(F.count(F.lit(1)).alias("same"))
    return met.where(enough_shared(F.col("same"), F.col("gn"), F.col("kn"))).select("g", "k")


def similarity_links(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and the members of each set: (a, b: classes, a < b) and (key, n_shingles, class).

    A class is the documents of one set; its id is the set's hash, null for texts without shingles. All pairs of classes
    that the prefixes leave possible are verified on whole sets, also within a component. Links of documents are the
    links joined with the members of either side, and all pairs within a class.
    """
    small_batches(df.sparkSession)
    tidy(df.sparkSession)
    docs, sets, nodes, tokens = prepared(df, key, text)
    pairs = written(group_pairs(tokens, nodes), "group-pairs")
    member = lambda g, node: nodes.select(F.col("grp").alias(g), F.col("node").alias(node))
    across = pairs.join(member("g", "a"), "g").join(member("k", "b"), "k").select("a", "b")
    within = member("g", "a").join(member("g", "b"), "g").where("a < b").select("a", "b")
    both = across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Keys made up for null ones are told by joining them with the rows again, as in similarity_components.
    made_up = docs.where("of is null").select("key").distinct().withColumn("null_key", F.lit(True))
    members = sets.join(made_up, "key", "left").select(F.when(F.col("null_key").isNull(), F.col("key")).alias(key), F.col("n").alias("n_shingles"), F.col("node").alias("class"))
    return verified(both, docs, nodes), written(members, "members")


def link_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, n_shingles, class, n_links (the other rows that it links with, those of its own class
    included). Texts without shingles have a null class and no links."""
    links, members = similarity_links(df, key, text)
    size = written(members.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("size")), "class-sizes")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = ends.join(size.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("size").alias("far"))
    each = size.join(far, "class", "left").select("class", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return members.join(each, "class", "left").select(key, "n_shingles", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similarity_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, n_shingles, component_id (the smallest key that links reach, its own included).

    Texts that are null or without words have no shingles, link with nothing and keep their own key. Rows of null key
    take part; a component of such rows alone has a null id. Repeated rows stay. Other columns are not looked at.
    """
    small_batches(df.sparkSession)
    tidy(df.sparkSession)
    docs, sets, nodes, tokens = prepared(df, key, text)
    of_groups = nodes.groupBy("grp").agg(F.min("node").alias("hub_node"), F.min("n").alias("n"))
    rep = of_groups.select("grp", "hub_node")
    near = nodes.join(rep, "grp").where("node <> hub_node").select(F.col("node").alias("a"), F.col("hub_node").alias("b"))
    known = written(nodes.withColumn("component", F.col("node")), "known")
    wide = written(tokens.groupBy("grp").agg(F.count(F.lit(1)).alias("wide")), "wide")
    first = None
    for i in range(ROUNDS):
        # A group whose nodes lie in several components counts as part of the smallest here.
        of = known.groupBy("grp").agg(F.min("component").alias("component")).join(wide, "grp")
        listed = tokens.select("token", "grp", "n").join(of, "grp")
        # The first hub is the one with most shared shingles: of a family of copies, one with few shingles of its own.
        order = lambda j: F.struct(*([] if i + j else [(-F.col("wide")).alias("wide")]), F.xxhash64("grp", F.lit(HUBS * i + j)).alias("hash"))
        hub = [F.min_by(F.struct("grp", "n", "component", F.lit(j).alias("turn")), order(j)) for j in range(HUBS)]
        hubs = listed.groupBy("token").agg(F.array_distinct(F.array(*hub)).alias("hubs"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token", "hubs")
        met = listed.join(hubs, "token").select("grp", "n", "component", F.explode("hubs").alias("hub")).where((F.col("component") != F.col("hub.component")) & may_link(F.col("n"), F.col("hub.n")))
        met = met.groupBy("grp", "n", F.col("hub.grp").alias("to"), F.col("hub.n").alias("to_n"), F.col("hub.turn").alias("turn")).agg(F.count(F.lit(1)).alias("same"))
        best = met.groupBy("grp", "n", "turn").agg(F.max(F.struct("same", "to", "to_n")).alias("h")).where(enough_shared(F.col("h.same"), F.col("n"), F.col("h.to_n")))
        far = best.select("grp", F.col("h.to").alias("to")).join(rep, "grp").select("to", F.col("hub_node").alias("a")).join(rep.select(F.col("grp").alias("to"), F.col("hub_node").alias("b")), "to").select("a", "b")
        found = verified(far if i else far.unionByName(near), docs, nodes)
        if i and not found.take(1):
            break
        first = found if first is None else first.unionByName(found)
        known = written(nodes.join(components(first), "node", "left").select("node", "grp", "n", F.coalesce("component", "node").alias("component")), "known")
    per_group = written(known.groupBy("grp", "component").agg(F.min("n").alias("n")), "group-components")
    # Tokens whose groups all lie in one component are done with.
    listed = tokens.select("token", "grp").join(per_group, "grp")
    open_ = listed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    spans = per_group.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    side = open_postings(tokens.select("token", F.col("grp"), "n").join(open_, "token").join(spans, "grp").withColumnRenamed("grp", "g"))
    side = first_postings(merged_tokens(side)).join(group_parities(nodes, "g"), "g")
    left = side.select("token", "cls", "other", "g", F.col("rest").alias("gr"), F.col("n").alias("gn"), F.col("low").alias("gl"), F.col("high").alias("gh"), *PARITIES)
    own = [F.col(c).alias(c + "_") for c in PARITIES]
    right = side.select("token", F.col("other").alias("cls"), F.col("cls").alias("other"), F.col("g").alias("k"), F.col("rest").alias("kr"), F.col("n").alias("kn"), F.col("low").alias("kl"), F.col("high").alias("kh"), *own)
    apart = (F.col("gl") != F.col("kl")) | (F.col("gl") != F.col("gh")) | (F.col("kl") != F.col("kh"))
    room = may_link(F.col("gn"), F.col("kn")) & enough_shared(F.least("gr", "kr"), F.col("gn"), F.col("kn")) & near_enough(F.col("gn"), F.col("kn"), "_")
    crossed = left.join(right, ["token", "cls", "other"]).where((F.col("g") < F.col("k")) & apart & room)
    within = per_group.groupBy("grp").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col("grp").alias("g"), F.col("grp").alias("k"))
    pairs = written(crossed.select("g", "k").distinct().unionByName(within), "group-pairs")
    member = lambda g, node, c: known.select(F.col("grp").alias(g), F.col("node").alias(node), F.col("component").alias(c))
    expanded = pairs.join(member("g", "a", "ca"), "g").join(member("k", "b", "cb"), "k").where("ca <> cb and a <> b")
    second = verified(expanded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), docs, nodes)

    linked = written(components(first.unionByName(second)), "components")
    last = nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    by_row = sets.select("key", "n", "node")
    # Keys made up for null ones are told by joining them with the rows again; only rows of null key take that way.
    made_up = docs.where("of is null").select("key").distinct()
    named = by_row.join(made_up.withColumn("null_key", F.lit(True)), "key", "left").select(F.when(F.col("null_key").isNull(), F.col("key")).alias("of"), "n", "node")
    placed = written(named.join(last, "node", "left").select("of", "n", "component"), "placed")
    smallest = placed.where("component is not null").groupBy("component").agg(F.min("of").alias("smallest"))
    out = placed.join(smallest, "component", "left")
    return out.select(F.col("of").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("of")).otherwise(F.col("smallest")).alias("component_id"))
