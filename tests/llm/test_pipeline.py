"""The pipeline's stages, each held against brute force on its own input."""

import corpus_pipeline
from galena.llm.shared import written
from tests.llm.conftest import SF
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_native import judged
from tests.llm.test_similarity import brute as brute_groups


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SF), "stage")
        after = {r.doc_id: r for r in docs.collect()}
        seen.append(len(after))
        texts = [(r.doc_id, r.text) for r in before]
        if name != "token ids":
            assert docs.columns == columns
        if name == "line dedup":
            want = {k: t for k, (t, n) in brute_lines(texts).items() if not n or t.strip()}
            assert {k: r.text for k, r in after.items()} == want
        elif name == "near duplicates":
            assert set(after) == {k for k, n, c in brute_groups(texts) if not n or k == c}
        elif name == "decontamination":
            assert set(after) == {k for k, t in texts if not judged(t, bench)[4]}
        elif name == "token ids":
            assert set(after) == {k for k, _ in texts} and all(r.round_trip and len(r.ids) == r.n_tokens for r in after.values())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
    assert docs.count() == 0


def test_stages_keep_to_rows(spark):
    """Nulls in every column, repeated rows, rows of one id with different texts, extra columns with clashing names."""
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, text("a")), (1, text("a")), (1, text("b")), (2, text("a")), (None, text("c")), (None, text("c")), (None, None), (3, None), (4, ""), (4, ""), (5, item), (5, text("d")), (6, text("b", 61)), (None, None)]
    docs = spark.createDataFrame([(k, t, None, "s", None, 1, 2, 3) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, n_removed_ int, row_hash int, rejected int")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {tuple(r)[-3:] for r in out.collect()} == {(1, 2, 3)}
        after[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert after["toxicity"] == sorted(rows, key=str)
    once = [(1, text("a")), (1, text("b")), (None, text("c")), (5, text("d")), (5, item)]
    empty = [(None, None), (3, None), (4, ""), (4, ""), (None, None)]
    assert after["near duplicates"] == sorted(once + empty, key=str)
    assert after["decontamination"] == sorted([r for r in rows if r != (5, item)], key=str)
    ids = corpus_pipeline.encode(spark, docs, SF).collect()
    assert len(ids) == len(rows) and all(r.round_trip for r in ids)
