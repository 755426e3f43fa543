"""Language identification of mixed texts: scripts narrow the languages, Viterbi labels spans of words.

A word is a run of letters (Unicode category L) of one script. Its candidates are the languages in which its script was
learned; its score in each is a naive Bayes sum over the n-grams around its letters, against the best language and no
worse than FLOOR. The labels of a text's words are the path of the best total score less PENALTY for each switch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.samples import held_out
from galena.llm.shared import batches, free_name, give_back, small_batches, written

#: Code point ranges (first, last) of the scripts that are told apart; letters elsewhere are of script "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
NAMES = [*SCRIPTS, "other"]
#: Places of n-grams, and their longest.
BITS, GRAMS = 16, 4
#: The lowest score of a word in any language against its best one, and what a switch costs (natural logarithms).
FLOOR, PENALTY = -8.0, 16.0
#: Texts that are learned from, of each language, those of the smallest hash; languages that one model may have.
MOST_TEXTS, MOST_LANGUAGES = 2_000, 1_000
#: Bytes of text that are labelled at once; a longer text by itself.
AT_ONCE = 8 << 20
#: Words, and letters in them, whose scores a task remembers.
WORDS, LETTERS = 200_000, 4_000_000
#: Share of a language's letters that a script needs to be one of the language.
LEAST_SHARE = 0.01


STARTS, ENDS, WHICH = (np.array(v) for v in zip(*sorted((a, b, i) for i, own in enumerate(SCRIPTS.values()) for a, b in own), strict=True))
CLASSES = ["".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in own) for own in SCRIPTS.values()]
#: The longest stretches of one script.
PIECES = re.compile("|".join([f"[{c}]+" for c in CLASSES] + [f"[^{''.join(CLASSES)}]+"]))


def script_of(codes: np.ndarray) -> np.ndarray:
    """The number in NAMES of each code point's script."""
    at = np.searchsorted(STARTS, codes, side="right") - 1
    return np.where((at >= 0) & (codes <= ENDS[at]), WHICH[at], len(SCRIPTS)).astype(np.int64)


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where each text's runs of letters start (and the last one's end), the runs as numbers, and what each number stands
    for. Null texts have none."""
    parts = pc.split_pattern_regex(pc.fill_null(texts, ""), r"\PL+")
    coded = parts.flatten().dictionary_encode()
    ids, runs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    edge = parts.offsets.to_numpy().astype(np.int64)
    edge = edge - edge[0]
    some = np.array([bool(w) for w in runs], bool)[ids] if len(ids) else np.zeros(0, bool)
    return np.concatenate([[0], np.cumsum(some)])[edge], ids[some], runs


def by_script(run: str) -> list[str]:
    """The words of a run of letters: it is cut where the script changes."""
    return [run] if run.isascii() and run else PIECES.findall(run)


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the n-grams (a row for each letter of each word, lower-cased, with a blank at either end), the row at which
    each word starts, and each word's script."""
    low = [w.lower() for w in words]
    codes = letters(" " + " ".join(low) + "  ")
    at = np.flatnonzero(codes[:-2] != 32)
    sizes = np.array([len(w) for w in low])
    code, out = codes[at], []
    for n in range(1, GRAMS + 1):
        if n > 1:
            step = {2: -1, 3: 1, 4: 2}[n]
            code = code * np.uint64(0x100000001B3) + codes[at + step] + np.uint64(n)
        out.append((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    place = np.stack(out, axis=1).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return place, start, script_of(codes[at[start]].astype(np.int64))


class Model:
    """langs (sorted), table [places, langs] of logarithms, reach [scripts, langs]: which languages have which script."""

    def __init__(self, langs: list[str], table: np.ndarray, reach: np.ndarray):
        self.langs, self.table, self.reach = langs, table, reach

    def scores(self, words: list[str]) -> np.ndarray:
        """The score of each word in each language: 0 for its best, FLOOR at the least, twice FLOOR if its script rules the
        language out. A script that no language has rules out none."""
        place, start, script = grams(words)
        s = np.add.reduceat(self.table[place].sum(axis=1), start, axis=0) / GRAMS
        allowed = self.reach[script] | ~self.reach[script].any(axis=1)[:, None]
        s = np.where(allowed, s, -np.inf)
        return np.where(allowed, np.maximum(s - s.max(axis=1, keepdims=True), FLOOR), 2 * FLOOR).astype(np.float32)


def stays(s: np.ndarray, edge: np.ndarray, best: np.ndarray, penalty: float) -> np.ndarray:
    """For each text whether its overall best language is its best path, as no language is ahead of it by more than half a
    penalty over any stretch: each stretch of another path gains half a penalty at most, and it has at least half as many
    switches as stretches."""
    sizes = np.diff(edge)
    own = np.repeat(np.arange(len(sizes)), sizes)
    out = np.ones(len(sizes), bool)
    for k in range(s.shape[1]):
        ahead = np.cumsum(s[:, k] - s[np.arange(len(s)), best[own]], dtype=np.float64)
        ahead -= np.concatenate([[0.0], ahead])[edge[:-1]][own]
        fall = 2 * (np.abs(ahead).max() + 1) * np.arange(len(sizes))  # keeps the minimum of a text from the next one
        low = np.minimum(np.minimum.accumulate(ahead - fall[own]) + fall[own], 0.0)
        before = np.concatenate([[0.0], low[:-1]])
        before[edge[:-1]] = 0.0
        out &= np.maximum.reduceat(ahead - before, edge[:-1]) <= penalty / 2 - 1e-3
    return out


def viterbi(s: np.ndarray, edge: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The labels of each text's best path over word scores [words, langs]; of equal ones that of fewer switches, then of
    the first labels. edge: where each text's words start, and the end; no text is empty. All texts take a step at once."""
    best = np.add.reduceat(s, edge[:-1], axis=0, dtype=np.float64).argmax(axis=1)
    sizes = np.diff(edge)
    path = np.repeat(best, sizes)
    rest = np.flatnonzero(~stays(s, edge, best, penalty))
    rest = rest[np.argsort(-sizes[rest], kind="stable")]
    if not len(rest):
        return path
    first, size, k = edge[rest], sizes[rest], s.shape[1]
    going = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts that have more than so many words
    came, same = np.zeros((len(s), k), np.int16), np.arange(k, dtype=np.int16)
    total = s[first].astype(float)
    for t in range(1, int(size[0])):
        n = going[t]
        now, at = total[:n], first[:n] + t
        top = now.argmax(axis=1)
        floor = now[np.arange(n), top][:, None] - penalty
        came[at] = np.where(now >= floor, same, top[:, None])
        total[:n] = np.maximum(now, floor) + s[at]
    label = total.argmax(axis=1)
    path[first + size - 1] = label
    for t in range(int(size[0]) - 1, 0, -1):
        n = going[t]
        at = first[:n] + t
        label[:n] = came[at, label[:n]]
        path[at - 1] = label[:n]
    return path


class Labeller:
    """Labels texts by a model; remembers the scores of words. One belongs to one task."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}
        self.words: list[str] = []
        self.sizes, self.rows = np.zeros(0, np.int64), np.zeros((0, len(self.model.langs)), np.float32)

    def learn(self, runs: list[str]) -> None:
        """Keeps where the words of each run are, and how many, and their scores."""
        if len(self.words) > WORDS or self.sizes.sum() > LETTERS:
            self.forget()
        new, at = [], len(self.words)
        for run in runs:
            if run not in self.known:
                own = by_script(run)
                self.known[run] = (at + len(new), len(own))
                new += own
        scored = [self.model.scores(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
        self.rows, self.words = np.concatenate([self.rows, *scored]), self.words + new
        self.sizes = np.concatenate([self.sizes, np.array([len(w) for w in new], np.int64)])

    def label(self, texts: pa.Array) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans (start, end, language) of each text."""
        langs, edge, ids, runs = self.model.langs, *letter_runs(texts)
        out = [("und", 0.0, [])] * len(texts)
        if not len(ids) or not langs:
            return out
        self.learn(runs)
        start, many = np.array([self.known[r] for r in runs], np.int64).T
        at, times = start[ids], many[ids]
        if times.max() > 1:
            ends = np.cumsum(times)
            at = np.repeat(at - (ends - times), times) + np.arange(ends[-1])
            edge = np.concatenate([[0], ends])[edge]
        some = np.flatnonzero(np.diff(edge))
        edge = np.append(edge[some], edge[-1])
        s, sizes = self.rows[at], self.sizes[at]
        path = viterbi(s, edge)
        own = np.repeat(np.arange(len(some)), np.diff(edge))
        share = np.bincount(own * len(langs) + path, sizes, minlength=len(some) * len(langs)).reshape(len(some), -1)
        top = share.argmax(axis=1)
        told = np.add.reduceat(np.where((path == top[own])[:, None], s, 0), edge[:-1], axis=0, dtype=np.float64)
        lead = told[np.arange(len(some)), top][:, None]
        sure = 1 / np.exp(np.clip(told - lead, -700, 700)).sum(axis=1)
        score = share[np.arange(len(some)), top] / share.sum(axis=1) * sure
        turns = np.flatnonzero((np.diff(path) != 0) & (np.diff(own) == 0)) + 1
        turned = np.searchsorted(turns, edge)
        for i, text in enumerate(some.tolist()):
            cuts = [int(edge[i]), *turns[turned[i] : turned[i + 1]].tolist(), int(edge[i + 1])]
            out[text] = (langs[top[i]], float(score[i]), self.spans(texts[text].as_py(), at, path, cuts))
        return out

    def spans(self, text: str, at: np.ndarray, path: np.ndarray, cuts: list[int]) -> list[tuple[int, int, str]]:
        """Start and end in the text, and language, of the words between cuts."""
        words, langs = self.words, self.model.langs
        if len(cuts) == 2:
            last = words[at[cuts[1] - 1]]
            return [(text.index(words[at[cuts[0]]]), text.rindex(last) + len(last), langs[path[cuts[0]]])]
        out, place = [], 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            first = None
            for i in at[a:b].tolist():  # between words are no letters, so the next place of a word is its own
                place = text.index(words[i], place)
                first = place if first is None else first
                place += len(words[i])
            out.append((first, place, langs[path[a]]))
        return out


def gathered(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, as many together as AT_ONCE holds: the longest text of all that are labelled together sets the steps."""
    held, size = [], 0
    for b in batches(frames):
        if held and size + b.nbytes > AT_ONCE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.Table.from_batches(held)


def learned(docs: DataFrame, most: int = MOST_TEXTS) -> Model:
    """The model of docs (key, text, lang). Of each language, its `most` texts of the smallest hash are looked at, and all
    that share the last one's hash; n-grams of those are counted where the texts lie and summed up by language."""
    spark = docs.sparkSession
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(~held_out(F.col("key"))).withColumn("hash", F.xxhash64("key", F.length("text"), F.substring("text", 1, 64)))
    ranked = docs.select("lang", "hash").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("rank") <= most)
    last = ranked.groupBy("lang").agg(F.max("hash").alias("last")).limit(MOST_LANGUAGES + 1).collect()
    if len(last) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(r.lang for r in last)
    number = {lang: i for i, lang in enumerate(langs)}
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    bound = F.broadcast(spark.createDataFrame(last, "lang string, last bigint"))  # MOST_LANGUAGES rows
    sample = docs.join(bound, "lang").where("hash <= last").select("lang", "text")

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches(frames):
            edge, ids, found = letter_runs(b.column("text"))
            cut = [by_script(r) for r in found]
            words = [w for c in cut for w in c]
            which = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
            own = np.repeat([number[lang] for lang in b.column("lang").to_pylist()], np.diff(edge))
            for lang in np.unique(own).tolist():
                n = held.setdefault(lang, np.zeros((1 << BITS) + len(NAMES)))
                times = np.bincount(ids[own == lang], minlength=len(cut))[which]
                for i in range(0, len(words), 20_000):
                    some, weight = words[i : i + 20_000], times[i : i + 20_000]
                    place, _, script = grams(some)
                    sizes = np.array([len(w.lower()) for w in some])
                    n[: 1 << BITS] += np.bincount(place.ravel(), np.repeat(weight, sizes * GRAMS), minlength=1 << BITS)
                    n[1 << BITS :] += np.bincount(script, sizes * weight, minlength=len(NAMES))
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "place", "n"])
        give_back()

    summed = sample.mapInArrow(count, "lang int, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n"))

    def weigh(table: pa.Table) -> pa.Table:
        n = np.zeros((1 << BITS) + len(NAMES))
        n[table["place"].to_numpy()] = table["n"].to_numpy()
        gram, script = n[: 1 << BITS], n[1 << BITS :]
        logs = np.log((gram + 0.5) / (gram.sum() + 0.5 * len(gram))).astype(np.float32)
        has = script >= LEAST_SHARE * max(1.0, script.sum())
        return pa.table({"lang": table["lang"][:1], "logs": [logs.tobytes()], "has": [has.tolist()]})

    rows = summed.groupBy("lang").applyInArrow(weigh, "lang int, logs binary, has array<boolean>").collect()  # 4 << BITS bytes a language
    table, reach = np.full((1 << BITS, len(langs)), -BITS * np.log(2), np.float32), np.zeros((len(NAMES), len(langs)), bool)
    for r in rows:
        table[:, r.lang], reach[:, r.lang] = np.frombuffer(bytes(r.logs), np.float32), r.has
    return Model(langs, table, reach)


def identify_languages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MOST_TEXTS) -> DataFrame:
    """One row per row of df: key, held_out, lang_pred, score (0 to 1), spans (start and end in code points, lang).

    lang_pred has the most letters in the spans (ties: the first by name), score is its share of the letters times the
    probability that the spans' words give it. Learned from text and lang of rows that are not held out, at most `most` or
    so of each language; lang of no other row counts. Without a letter, for null texts and where nothing can be learned:
    `und`, 0, no spans. Keys may be null or repeated. Other columns are not looked at.
    """
    small_batches(df.sparkSession)
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = df.sparkSession.sparkContext.broadcast(learned(own, most))  # 4 << BITS bytes a language

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model.value)
        for t in gathered(frames):
            found = labeller.label(t["text"].combine_chunks())
            spans = pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in f[2]] for f in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
            keys = t["key"].combine_chunks()
            yield pa.RecordBatch.from_arrays([keys, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans], names=["key", "lang_pred", "score", "spans"])
        del labeller
        give_back()

    kind = df.schema[key].dataType.simpleString()
    made = own.select("key", "text").mapInArrow(run, f"key {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    return made.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "lang_pred", "score", "spans")
