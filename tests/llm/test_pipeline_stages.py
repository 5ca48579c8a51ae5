"""All stages of the pipeline in turn, over odd rows, and bounds of what two operators hold."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import crf, secret_scan

WORDS = [a + b for a in ("th", "st", "pl", "gr", "m", "f", "cl") for b in ("an", "ore", "ight", "ack", "ound", "eeds", "ile")]


def prose(rng, n=120):
    return " ".join(" ".join(rng.choices(WORDS, k=12)) + "." for _ in range(n // 12))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad documents, copies, a near copy, nulls, repeated ids, secrets; labels of most; a column whose name stages use inside."""
    rng = random.Random(3)
    good = [prose(rng) for _ in range(30)]
    bad = ["\n".join(" | ".join(rng.choices(["BUY", "$$$", "###", "NOW!!"], k=12)) for _ in range(12)) for _ in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(x for pair in zip(good, bad) for x in pair)]
    rows += [(100, good[0], "en"), (101, good[0] + " extra.", "en"), (102, good[1] + " password = abcdefghijklmnop123", "en"), (2, good[1], "en"), (2, prose(rng), "en"), (None, prose(rng), "en"), (103, None, "en"), (104, "", None), (105, prose(rng, 6000), "en")]
    path = str(tmp_path_factory.mktemp("stages"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("bigint"), "score": F.lit(0.1), "id": F.lit("x"), "label": F.lit(7)})
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1 - i % 2, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_does_its_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {(r["doc_id"], r["text"]) for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/out-{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
        kept.append({(r["doc_id"], r["text"]) for r in docs.collect()} if name != "packing" else docs.collect())
    classified, ruled, unique, clean, pieces = kept
    good = {i for i in range(0, 60, 2)}
    assert {i for i, _ in classified} >= good | {100, 101, 102} and not {i for i, _ in classified} & set(range(1, 60, 2))
    assert ruled < classified | ruled and not any(t in (None, "") for _, t in ruled) and {i for i, _ in ruled} >= good
    ids = {i for i, _ in unique}
    assert unique <= ruled and {100, 101} & ids == set() and 0 in ids and None in ids and 105 in ids
    assert len([1 for i, _ in unique if i == 2]) == 2  # both rows of the repeated id differ from each other
    assert {i for i, _ in clean} == ids and not any("abcdefghijklmnop123" in t for _, t in clean)
    assert before >= unique and {(i, t) for i, t in clean if "[SECRET]" not in t} <= unique
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert set(by_doc) == {i for i, _ in clean}
    for doc_id, own in by_doc.items():
        rows = sum(1 for i, _ in clean if i == doc_id)
        total = sum(p["length"] for p in own)
        assert rows > 1 or total == own[0]["doc_tokens"]


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_classifier_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    sizes = []
    real = crf.fit
    monkeypatch.setattr(crf, "fit", lambda found, chars, rows, label: sizes.append(len(label)) or real(found, chars, rows, label))
    rows = [(i, f"plain words {i} of {k}." if i else f"$$$ ### {k}") for i in (0, 1) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = crf.train(docs, spark.createDataFrame([(0, 0), (1, 1)], "doc_id bigint, quality int"))
    assert sizes == [2] and model is not None


def test_spans_take_time_in_proportion(spark):
    rng = random.Random(1)
    formats = secret_scan.learn_formats(spark.createDataFrame([(f"token = {''.join(rng.choices('abcdef0123456789', k=20))}",) for _ in range(50)], "text string"))
    text = " ".join("".join(rng.choices("0123456789abcdef", k=20)) for _ in range(40_000))
    began = time.perf_counter()
    assert len([k for k, _, _ in secret_scan.find_spans(text, formats) if k == "hex"]) == 40_000
    assert time.perf_counter() - began < 20
