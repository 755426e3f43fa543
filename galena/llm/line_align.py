"""Line dedup by pairwise alignment.

Documents are paired through shared runs of lines: from each line on, and up to each line, the shortest run of at least
`least` words (MIN_WORDS by default) is hashed, and every document that has a run is paired with the first document that has it. That is one
pair for a run and document however many documents share it, and every line of every common block of so many words
lies in such a run: the rare runs lead to their few holders, the common ones to their first. Each pair is aligned by
patience diff over the lines both have. What the alignment leaves, as it keeps to the order and takes a line once, is
aligned again in rounds, run by run. Aligned common blocks of at least so many words are deleted from the later document,
which is what a comparison with every earlier document finds; nothing is deleted that is not aligned.

Documents are in order of their key, null last, then of their text's hash. Lines without words are not aligned: they are
looked past, and stay. Every deleted line stands in an earlier document, so its first occurrence always stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.shared import batches, free_name, small_batches, tidy, written

MIN_WORDS = 20
NO_LINE = -1


def worded_lines(text: bytes) -> list[tuple[int, int, int]]:
    """(line number, hash, words) of each line that has a word."""
    out = []
    for i, line in enumerate(text.split(b"\n")):
        words = len(line.split())
        if words:
            out.append((i, xxhash.xxh64_intdigest(line) - (1 << 63), words))
    return out


def windows(words: list[int], least: int = MIN_WORDS) -> set[tuple[int, int]]:
    """(start, end) of the shortest run of at least so many words from each line on, and up to each line."""
    out, start, total = set(), 0, 0
    for end, w in enumerate(words, 1):  # up to each line
        total += w
        while total - words[start] >= least:
            total -= words[start]
            start += 1
        if total >= least:
            out.add((start, end))
    end = total = 0
    for start, w in enumerate(words):  # from each line on
        while end < len(words) and total < least:
            total += words[end]
            end += 1
        if total < least:
            break
        out.add((start, end))
        total -= w
    return out


def runs(hashes: list[int], words: list[int], least: int = MIN_WORDS) -> Iterator[int]:
    """The hashes of a document's runs."""
    own = np.array(hashes, np.int64)
    for start, end in windows(words, least):
        yield xxhash.xxh64_intdigest(own[start:end].tobytes()) - (1 << 63)


def longest_ascent(values: list[int]) -> list[int]:
    """Indexes of a longest strictly ascending subsequence."""
    tops, piles, before = [], [], []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        before.append(piles[at - 1] if at else NO_LINE)
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else NO_LINE
    while i != NO_LINE:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: dict[int, int], b: dict[int, int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences, given as place → line hash of the lines that both have.

    Lines that are unique on both sides within a stretch are matched in their longest common order; matches grow to
    equal neighbours; the stretches between are aligned likewise. Places without an entry match nothing.
    """
    out, todo = [], [(-1, max(a, default=0) + 1, -1, max(b, default=0) + 1)]
    places_a, places_b = sorted(a), sorted(b)
    while todo:
        lo, hi, low, high = todo.pop()
        once: dict[int, list[list[int]]] = {}
        for side, (own, places, x, y) in enumerate(((a, places_a, lo, hi), (b, places_b, low, high))):
            for p in places[bisect_left(places, x + 1) : bisect_left(places, y)]:
                once.setdefault(own[p], [[], []])[side].append(p)
        alone = sorted((x[0], y[0]) for x, y in once.values() if len(x) == len(y) == 1)
        anchors = [alone[i] for i in longest_ascent([y for _, y in alone])]
        if not anchors:
            # Without unique lines the stretch's ends may still match; the first and last equal lines are tried.
            matched = []
            i, j = lo + 1, low + 1
            while i < hi and j < high and a.get(i) is not None and a.get(i) == b.get(j):
                matched.append((i, j))
                i, j = i + 1, j + 1
            k, m = hi - 1, high - 1
            while k >= i and m >= j and a.get(k) is not None and a.get(k) == b.get(m):
                matched.append((k, m))
                k, m = k - 1, m - 1
            out += matched
            continue
        matched, edge_i, edge_j = [], lo, low
        for x, y in anchors:
            if x <= edge_i or y <= edge_j:
                continue
            i, j = x, y
            while i - 1 > edge_i and j - 1 > edge_j and a.get(i - 1) is not None and a.get(i - 1) == b.get(j - 1):
                i, j = i - 1, j - 1
            if i - 1 > edge_i and j - 1 > edge_j:
                todo.append((edge_i, i, edge_j, j))
            while i <= x or (i < hi and j < high and a.get(i) is not None and a.get(i) == b.get(j)):
                matched.append((i, j))
                i, j = i + 1, j + 1
            edge_i, edge_j = i - 1, j - 1
        if edge_i + 1 < hi and edge_j + 1 < high:
            todo.append((edge_i, hi, edge_j, high))
        out += matched
    return sorted(out)


def aligned_blocks(later: dict[int, int], earlier: dict[int, int], words: dict[int, int], least: int = MIN_WORDS) -> set[int]:
    """Places of the later document in aligned blocks (neighbours on both sides) of at least so many words."""
    out, block, last = set(), [], (NO_LINE - 1, NO_LINE - 1)
    for i, j in [*patience(later, earlier), (1 << 60, 1 << 60)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[p] for p in block) >= least:
                out.update(block)
            block = []
        block.append(i)
        last = (i, j)
    return out


def placed_runs(lines: dict[int, int], words: dict[int, int], least: int = MIN_WORDS) -> list[tuple[list[int], tuple[int, ...]]]:
    """The places and the line hashes of each run of a sequence, given as place → line hash, in order. words: by line hash."""
    out, stretch = [], []
    for p in [*sorted(lines), 1 << 60]:
        if stretch and p != stretch[-1] + 1:
            for start, end in sorted(windows([words[lines[x]] for x in stretch], least)):
                own = stretch[start:end]
                out.append((own, tuple(lines[x] for x in own)))
            stretch = []
        stretch.append(p)
    return out


def first_places(runs_: list[tuple[list[int], tuple[int, ...]]], known: dict[tuple[int, ...], int]) -> dict[int, int]:
    """A sequence of runs, each distinct one where it comes first, as place → number of the run in known."""
    out: dict[int, int] = {}
    seen: set[int] = set()
    for i, (_, run) in enumerate(runs_):
        n = known.get(run)
        if n is not None and n not in seen:
            seen.add(n)
            out[i] = n
    return out


def common_blocks(later: dict[int, int], earlier: dict[int, int], words: dict[int, int], least: int = MIN_WORDS) -> list[int]:
    """Places of the later document in blocks of at least so many words that the earlier one has. words: by place of the
    later document.

    The lines are aligned first. What that leaves, as an alignment keeps to the order and takes a line once, is aligned
    again, run by run instead of line by line, until no aligned run is left: a round aligns at least one of those that
    both have, and a run that is aligned goes wherever the later document repeats it.
    """
    out = aligned_blocks(later, earlier, words, least)
    if len(out) == len(later):
        return sorted(out)
    by_line = {h: words[p] for p, h in later.items()}
    mine = placed_runs(later, by_line, least)
    theirs = placed_runs({p: h for p, h in earlier.items() if h in by_line}, by_line, least)
    known = {run: i for i, run in enumerate(dict.fromkeys(run for _, run in theirs))}
    there = first_places(theirs, known)
    while left := [(own, run) for own, run in mine if run in known and not out.issuperset(own)]:
        here = first_places(left, known)
        wanted = set(here.values())
        met = {left[i][1] for i, _ in patience(here, {j: n for j, n in there.items() if n in wanted})}
        if not met:
            break
        for own, run in left:
            if run in met:
                out.update(own)
    return sorted(out)


def removed_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """key, removed: the numbers of the lines to delete, for the documents that have any. docs: key, text."""

    def split(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            found = [worded_lines(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
            cols = [pa.array([[x[i] for x in doc] for doc in found], pa.list_(kind)) for i, kind in ((0, pa.int32()), (1, pa.int64()), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("key"), *cols], names=["key", "numbers", "hashes", "words"])

    key = docs.schema["key"].dataType.simpleString()
    lines = written(docs.mapInArrow(split, f"key {key}, numbers array<int>, hashes array<bigint>, words array<int>").dropDuplicates(["key"]), "lines")

    def units(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            at, out = [], []
            for i, (h, w) in enumerate(zip(b.column("hashes").to_pylist(), b.column("words").to_pylist(), strict=True)):
                own = set(runs(h, w, least))
                at += [i] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(out, pa.int64())], names=["key", "run"])

    units_ = lines.select("key", "hashes", "words").mapInArrow(units, f"key {key}, run bigint")
    held = written(units_, "runs")
    shared = held.groupBy("run").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last").select("run", "first")
    pairs = written(held.join(shared, "run").where("key <> first").select("key", "first").distinct(), "pairs")

    # The lines both sides of a pair have, each with its places on either side.
    one = lines.select("key", F.posexplode(F.arrays_zip("hashes", "words")).alias("place", "l"))
    one = one.groupBy("key", F.col("l.hashes").alias("hash")).agg(F.collect_list("place").alias("places"), F.max("l.words").alias("w"))
    one = written(one, "line-places")
    mine = pairs.join(one, "key")
    theirs = one.select(F.col("key").alias("first"), "hash", F.col("places").alias("there"))
    both = mine.join(theirs, ["first", "hash"]).groupBy("key", "first").agg(F.collect_list(F.struct("hash", "w", "places", "there")).alias("common"))

    def align(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            out = []
            for common in b.column("common").to_pylist():
                later = {p: c["hash"] for c in common for p in c["places"]}
                earlier = {p: c["hash"] for c in common for p in c["there"]}
                out.append(common_blocks(later, earlier, {p: c["w"] for c in common for p in c["places"]}, least))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(pa.int32()))], names=["key", "places"])

    found = both.mapInArrow(align, f"key {key}, places array<int>").where(F.size("places") > 0)
    all_places = found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    numbers = F.transform("places", lambda p: F.get("numbers", p))
    return all_places.join(lines.select("key", "numbers"), "key").select("key", numbers.alias("removed"))


def dedupe_lines(df: DataFrame, key: str = "doc_id", text: str = "text", lines: str = "n_lines_", removed: str = "n_removed_", min_words: int = MIN_WORDS) -> DataFrame:
    """df with the aligned common blocks deleted from its texts, and the counts of lines before and of lines deleted.

    min_words: the fewest words of a block. The fewer, the more is found, and the more lines go that texts share by
    their form only: at 20, headings and licence lines stay, passages of two sentences go. Null texts stay null, with
    one empty line; texts without a common block stay as they are, byte for byte. Rows that are equal in key and text
    count as one document and share its result. Other columns stay, whatever their names, but for the two counts, whose
    names must be free.
    """
    if {lines, removed} & set(df.columns):
        raise ValueError("the names of the counts are taken")
    small_batches(df.sparkSession)
    tidy(df.sparkSession)
    own, own_key, of, lost = F.col(text), free_name(df, "own_key"), free_name(df, "of_key"), free_name(df, "lost")
    order = F.struct(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(own).alias("text"))
    gone = written(removed_lines(df.select(order.alias("key"), own.alias("text")), min_words), "removed-lines")
    gone = gone.select(F.col("key").alias(of), F.col("removed").alias(lost))
    # The table of removals grows with the documents, so it is not to be broadcast at any size.
    both = df.withColumn(own_key, order).join(gone.hint("merge"), F.col(own_key) == F.col(of), "left")
    kept = F.array_join(F.filter(F.split(own, "\n"), lambda x, i: ~F.array_contains(lost, i)), "\n")
    columns = [F.when(F.col(lost).isNull(), own).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    total = F.size(F.split(F.coalesce(own, F.lit("")), "\n")).cast("bigint").alias(lines)
    return both.select(*columns, total, F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)).cast("bigint").alias(removed))
