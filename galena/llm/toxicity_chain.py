"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear logistic models. Each model sees word features of the text and
the probabilities that the models before it gave; in training those come from models that had not seen the row (out of
fold), so that a model learns to trust its predecessors as much as they deserve on new texts.

Features are the beginnings of words (4 to 7 bytes, A-Z lower-cased) and whole words of up to 7 bytes: how often a text
has them, in logarithms. In texts of more words than most of the sample have, counts are taken down to that many words,
so that a long text has no more of a word by chance than a short one. A model uses those that its training rows show to
go with its category.

Where labels only tell whether a text is toxic, the narrower categories are kinds of toxicity found in the labelled rows
themselves: the toxic rows of each group (a language) are parted in two by the telling words that go together in them.
Kind 1 is the more frequent one of each group.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.samples import MAX_TRAIN, fit_in_one_task, held_out, labelled_sample
from galena.llm.shared import batches, free_name, small_batches

FIRST, LAST = 4, 7
FEATURES, FOLDS, LEAST_ROWS, SEED = 250, 10, 3, 11
#: Bytes of text whose words are looked at at once in a fit.
PART = 1 << 20


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature code) for every word of the texts, and the words of each text; letters are a-z and all
    bytes beyond ASCII."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    letter = np.concatenate(([False], ((data >= 97) & (data <= 122)) | (data >= 128), [False]))
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right") if texts else start
    wide, docs, codes = np.concatenate((data, np.zeros(LAST, np.uint8))), [], []
    code = np.zeros(len(start), np.uint64)
    for n in range(1, LAST + 1):
        code = code | np.where(size >= n, wide[start + n - 1], 0).astype(np.uint64) << np.uint64(8 * (n - 1))
        if n >= FIRST:
            docs.append(of[size >= n])
            codes.append(code[size >= n] | np.uint64(n << 56))
    docs.append(of[size <= LAST])
    codes.append(code[size <= LAST] | np.uint64((LAST + 1) << 56))
    return np.concatenate(docs), np.concatenate(codes), np.bincount(of, minlength=len(texts))


def graded(count: np.ndarray, n_words: np.ndarray, usual: float) -> np.ndarray:
    """The value of a feature that a text of n_words words has count times."""
    return np.log1p(count * np.minimum(1.0, usual / np.maximum(n_words, 1)))


def feature_counts(texts: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature code, times) of texts, of the sorted codes in known only if it is given; words by text."""
    rows, codes, times, sizes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PART):
            size += len(texts[end])
            end += 1
        row, code, n_words = word_codes(texts[at:end])
        if known is not None:
            keep = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code if len(known) else np.zeros(len(code), bool)
            row, code = row[keep], code[keep]
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
        rows.append(row[new] + at)
        codes.append(code[new])
        times.append(np.diff(np.append(np.flatnonzero(new), len(new))))
        sizes.append(n_words)
        at = end
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(times), np.concatenate(sizes)


def chance(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights, the last one the offset, of a ridge-penalised logistic model, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[-1] = 1e-4
    for _ in range(15):
        p = chance(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9)
        step = np.linalg.solve(h, x.T @ (p - y) + pull * w)
        w -= step
        if abs(step).max() < 1e-5:
            break
    return w


def select_features(row: np.ndarray, place: np.ndarray, n_places: int, y: np.ndarray, most: int) -> np.ndarray:
    """Places that occur in at least LEAST_ROWS rows of the category, and there clearly more often than elsewhere."""
    pos = np.bincount(place[y[row] > 0], minlength=n_places)
    neg = np.bincount(place[y[row] == 0], minlength=n_places)
    n_pos, n_neg = max(1, (y > 0).sum()), max(1, (y == 0).sum())
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    good = np.flatnonzero((pos >= LEAST_ROWS) & (odds > 1.5))
    return good[np.argsort(-(pos * odds)[good], kind="stable")][:most]


class Chain:
    """The chain's models: for each category its feature codes and weights."""

    def __init__(self, codes: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]], usual: float = 1.0):
        self.codes, self.models, self.usual = codes, models, usual  # sorted codes; per model: places in codes, weights

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """P of each category (column) for each text (row)."""
        x = np.zeros((len(texts), len(self.codes) + 1), np.float32)
        of, code, n_words = word_codes(texts)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[at] == code
            np.add.at(x, (of[known], at[known]), 1)
            x = graded(x, n_words[:, None], self.usual).astype(np.float32)
        before = np.zeros((len(texts), 0))
        for places, w in self.models:
            seen = np.hstack([x[:, places], before, np.ones((len(texts), 1))])
            before = np.hstack([before, chance(seen @ w)[:, None]])
        return before

    def packed(self) -> dict:
        parts = [[p.tolist(), w.tolist()] for p, w in self.models]
        return {"codes": self.codes.astype("<u8").tobytes(), "models": json.dumps([parts, self.usual])}

    @staticmethod
    def unpacked(m: dict) -> Chain:
        parts, usual = json.loads(m["models"])
        return Chain(np.frombuffer(bytes(m["codes"]), "<u8"), [(np.array(p, int), np.array(w)) for p, w in parts], usual)


class Sample:
    """The features of a labelled sample: those that at least LEAST_ROWS rows with any label have, row by row."""

    def __init__(self, texts: list[bytes], positive: np.ndarray):
        own = np.flatnonzero(positive)
        code, many = np.unique(feature_counts([texts[i] for i in own])[1], return_counts=True)
        self.codes, self.n = code[many >= LEAST_ROWS], len(texts)
        self.row, code, times, n_words = feature_counts(texts, self.codes)
        self.place = np.searchsorted(self.codes, code)
        self.usual = max(1.0, float(np.median(n_words)))
        self.value = graded(times, n_words[self.row], self.usual)

    def telling(self, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places of the features that go with the category in the given rows (a mask)."""
        own = rows[self.row]
        return np.sort(select_features(self.row[own], self.place[own], len(self.codes), np.where(rows, y, 0), FEATURES))

    def matrix(self, places: np.ndarray) -> np.ndarray:
        at = np.full(len(self.codes) + 1, -1)
        at[places] = np.arange(len(places))
        x, keep = np.zeros((self.n, len(places)), np.float32), at[self.place] >= 0
        x[self.row[keep], at[self.place[keep]]] = self.value[keep]
        return x


def two_parts(x: np.ndarray) -> np.ndarray:
    """The part, 0 (the larger one) or 1, of each row of x, by 2-means over directions; -1 for rows without a value.

    Starts from the two sides of the mean along the axis on which rows differ most.
    """
    size = np.linalg.norm(x, axis=1)
    of = np.full(len(x), -1)
    unit = x[size > 0] / size[size > 0, None]
    if not len(unit):
        return of
    off = unit - unit.mean(0)
    part = (off @ np.linalg.eigh(off.T @ off)[1][:, -1] > 0).astype(int)
    for _ in range(20):
        centres = np.stack([unit[part == j].sum(0) for j in (0, 1)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        part = (unit @ centres.T).argmax(1)
    of[size > 0] = part if 2 * part.sum() <= len(part) else 1 - part
    return of


def kinds(sample: Sample, toxic: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Two columns of 0 and 1: which toxic rows belong to which of two kinds, found in each group by itself.

    Only words that tell a group's toxic rows from its others count. Toxic rows without such a word are of neither kind,
    nor are those of a group that has fewer than twice LEAST_ROWS of them.
    """
    out = np.zeros((sample.n, 2), int)
    group = np.zeros(sample.n, int) if group is None else group
    for g in np.unique(group):
        own = (group == g) & (toxic > 0)
        if own.sum() >= 2 * LEAST_ROWS:
            part = two_parts(sample.matrix(sample.telling(toxic, group == g))[own])
            out[np.flatnonzero(own)[part >= 0], part[part >= 0]] = 1
    return out


def fit_chain(texts: list[bytes], labels: np.ndarray, sample: Sample | None = None) -> Chain:
    """labels: a column of 0 and 1 for each category, in the chain's order."""
    if not len(texts):
        return Chain(np.empty(0, np.uint64), [(np.empty(0, int), np.append(np.zeros(j), -30.0)) for j in range(labels.shape[1])])
    sample = sample or Sample(texts, labels.any(axis=1))
    fold = np.random.default_rng(SEED).permutation(len(texts)) % FOLDS
    before, chosen = np.zeros((len(texts), 0)), []

    def model(y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places = sample.telling(y, rows)
        x = np.hstack([sample.matrix(places), before])
        w = logistic_fit(x[rows], y[rows])
        return places, w, chance(x @ w[:-1] + w[-1])

    for j in range(labels.shape[1]):
        y, out_of_fold = labels[:, j], np.zeros(len(texts))
        for k in range(FOLDS):
            out_of_fold[fold == k] = model(y, fold != k)[2][fold == k]
        places, w, _ = model(y, np.ones(len(texts), bool))
        chosen.append((places, w))
        before = np.hstack([before, out_of_fold[:, None]])
    used = np.unique(np.concatenate([p for p, _ in chosen]).astype(int))
    return Chain(sample.codes[used], [(np.searchsorted(used, p), w) for p, w in chosen], sample.usual)


#: The chain where labels only say toxic or not: two kinds found in the labelled rows, then the label itself.
CATEGORIES = ["kind_1", "kind_2", "toxic"]


def train(docs: DataFrame, labels: DataFrame, categories: list[str], most: int = MAX_TRAIN) -> dict:
    """docs: key, text, group. labels: key and a column of 0 and 1 for each category (null: 0), in the chain's order.

    For CATEGORIES, labels has key and toxic only; the kinds are found in the sample, in each group by itself.
    """
    found = categories == CATEGORIES
    given = ["toxic"] if found else categories

    def fit(rows: list[dict]) -> dict:
        y = np.array([[1 if r[c] == 1 else 0 for c in given] for r in rows]).reshape(len(rows), len(given))
        texts = [(r["text"] or "").encode() for r in rows]
        sample = Sample(texts, y.any(axis=1)) if texts else None
        if found:
            groups = np.array([r["group"] or "" for r in rows])
            y = np.hstack([kinds(sample, y[:, 0], groups) if texts else np.zeros((0, 2), int), y])
        return fit_chain(texts, y, sample).packed()

    chosen = labelled_sample(docs, labels.select("key", *given), most, ("group",))
    return fit_in_one_task(chosen, fit, "codes binary, models string")


def predict(df: DataFrame, model: dict, names: list[str], text: str = "text") -> DataFrame:
    """Adds a column with the probability of each category to df, under the given names, which must be free; all other
    columns stay."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES codes and weights a category at most

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain.unpacked(shared.value)
        for b in batches(frames):
            texts = b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            p = np.concatenate([chain.predict([t or b"" for t in texts[i : i + 128]]) for i in range(0, len(texts), 128)])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, j]) for j in range(len(names)))], names=[*b.schema.names, *names])

    return df.mapInArrow(run, df.select("*", *(F.lit(0.0).alias(c) for c in names)).schema)


def score_toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = 0.5, most: int = MAX_TRAIN, group: str = "lang") -> DataFrame:
    """df with p_kind_1, p_kind_2, p_toxic and rejected (p_toxic >= threshold); df needs key and text.

    Where df has the group column, kinds of toxicity are found within its values (null is one of them); it is used for
    that alone and is no input of a score.

    Rows that held_out names are not learned from, nor labels that are null. A null text is judged as an empty one.
    Repeated rows and null keys stay. Without labels nothing is rejected. Where df has a column of such a name, it stays
    as it is, and the new one has underscores after its name.
    """
    own = F.col(f"`{group}`").cast("string") if group in df.columns else F.lit(None).cast("string")
    docs = df.select(F.col(key).cast("bigint").alias("key"), "text", own.alias("group"))
    told = labels.where(F.col("toxic").isNotNull()).select(F.col(key).cast("bigint").alias("key"), "toxic")
    names = [free_name(df, f"p_{c}") for c in CATEGORIES]
    scored = predict(df, train(docs, told, CATEGORIES, most), names)
    return scored.withColumn(free_name(df, "rejected"), F.col(names[-1]) >= threshold)


def drop_toxic(df: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """The rows of df that score_toxicity does not reject, with df's columns."""
    rejected = F.col(free_name(df, "rejected"))
    return score_toxicity(df, labels, key, threshold).where(~rejected).select([f"`{c}`" for c in df.columns])


__all__ = ["CATEGORIES", "drop_toxic", "fit_chain", "held_out", "predict", "score_toxicity", "train"]
