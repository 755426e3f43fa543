"""Operator 13: held-out accuracy, Viterbi against all paths, scripts, spans, messy rows."""

from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galena.llm import language_id, queries

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language_id.learned(docs.select(F.col("doc_id").alias("key"), "text", "lang"))


def test_languages_of_held_out_documents(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op13_language_id(spark, SF).join(lang, "doc_id")
    by = got.where("held_out").groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.count("*").alias("n")).collect()
    assert len(by) == 4 and all(r.right > 0.98 and r.n > 100 for r in by), by
    assert got.where("score < 0 or score > 1 or score is null").count() == 0 and got.count() == 10_000


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(2)
    for _ in range(60):
        sizes = draw.integers(1, 7, size=3)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        s = (-8 * draw.random((edge[-1], 3)) ** 2).astype(np.float32)
        penalty = float(draw.choice([0.5, 2.0, 6.0]))
        path = language_id.viterbi(s, edge, penalty)
        for a, b in zip(edge, edge[1:], strict=False):
            worth = lambda p: sum(float(s[a + i, k]) for i, k in enumerate(p)) - penalty * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
            assert worth(path[a:b].tolist()) >= max(map(worth, product(range(3), repeat=b - a))) - 1e-4


def test_spans_of_mixed_text(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long = {r.lang: r.text[:600].rsplit(" ", 1)[0] for r in docs.where("n_chars between 1500 and 4000 and not text rlike '[0-9#*$%&]'").orderBy("doc_id").collect()}
    text = f"12. {long['en']} -- {long['de']}"
    (lang, score, spans), = language_id.Labeller(model).label(pa.array([text]))
    assert [s[2] for s in spans] == ["en", "de"] and lang in ("en", "de") and 0.3 < score < 0.7
    cut = text.index(" -- ")
    assert spans[0][0] == 4 and abs(spans[0][1] - cut) < 40 and abs(spans[1][0] - cut) < 40 and text[spans[1][1] - 1].isalpha()
    assert not any(c.isalpha() for c in text[spans[0][1] : spans[1][0]])


def test_scripts_narrow_languages():
    words = ["the cat sat on the mat", "кот сидел на ковре", "ο γάτος στο χαλί"]
    langs = ["en", "ru", "el"]
    table, reach = np.zeros((1 << language_id.BITS, 3)), np.zeros((len(language_id.NAMES), 3), bool)
    for i, text in enumerate(words):
        place, _, script = language_id.grams(text.split())
        table[:, i] += np.bincount(place.ravel(), minlength=1 << language_id.BITS)
        reach[script, i] = True
    model = language_id.Model(langs, np.log((table + 0.5) / (table + 0.5).sum(axis=0)).astype(np.float32), reach)
    own = language_id.Labeller(model)
    texts = pa.array(["zzz qqq", "щщщ", "ΨΨ", "漢字 かな", "catкот", "9 ² ½ _", "", None])
    got = own.label(texts)
    assert [g[0] for g in got[:3]] == langs and got[3][0] in langs and [g[0] for g in got[5:]] == ["und"] * 3
    assert language_id.by_script("catкотcat漢字") == ["cat", "кот", "cat", "漢字"] and language_id.by_script("") == []
    assert [s[:2] for s in got[2][2]] == [(0, 2)] and got[4][2][0][0] == 0 and got[4][2][-1][1] == 6


def test_messy_rows(spark, messy):
    df = messy.selectExpr("* except (lang)", "case when doc_id = 1 then 'en' when doc_id = 10 then 'fr' end as lang", "'s' as spans", "1 as held_out")
    got = language_id.identify_languages(df).collect()
    assert len(got) == messy.count() and {r.lang_pred for r in got} <= {"en", "fr", "und"}
    none = {r.doc_id: r for r in got if r.doc_id in (2, 3, 4)}
    assert all(none[i].lang_pred == "und" and none[i].score == 0 and none[i].spans == [] for i in none)
    assert all(r.lang_pred != "und" for r in got if r.doc_id in (1, 5, 9, 10))
    unlearned = language_id.identify_languages(messy.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)} and len(unlearned) == messy.count()
    assert language_id.identify_languages(df.limit(0)).collect() == []


def test_long_texts_and_repeats_are_labelled_alike(model):
    own = language_id.Labeller(model)
    text = "the heated anon, " * 60_000
    together = own.label(pa.array([text, "de la que", text, None, "de la que"]))
    assert together[0] == together[2] == own.label(pa.array([text]))[0] and together[1] == together[4] and together[0][2][0][:2] == (0, len(text) - 2)
