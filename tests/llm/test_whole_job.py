import pytest
from pyspark.sql import functions as F

from captionloom.llm import license_scan, toxicity


def test_every_statement_counts_on_its_own(spark):
    """Each name in each form of statement, in a text without any other word."""
    forms = [
        "Released under {}.", "licensed under the {}", "Distributed under the terms of the {}.", "available-under {}", "PUBLISHED UNDER THE {}.",
        "This project is made available under {}.", "This library is dual licensed under {}.", "provided under the {}.", "SPDX-License-Identifier: {}",
    ]
    names = license_scan.NAMES | license_scan.OR_LATER
    spdx = {k: [k] for k in license_scan.OR_LATER}
    cases = [(form.format(x), name) for table in (names, spdx) for name, each in table.items() for x in each for form in forms]
    cases += [("Released under MIT.", "MIT"), ("Distributed under the GPL v3.", "GPL-3.0"), ("This project is available under Apache 2.0.", "Apache-2.0"),
              ("published under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Released under BSD 3-Clause.", "BSD-3-Clause")]
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(df).collect()}
    assert [(t, got[i]) for i, (t, name) in enumerate(cases) if got[i] != [name]] == []


def sampled(monkeypatch, docs, labels, **bounds):
    """The texts and labels that ``train`` fits on."""
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda texts, known, *rest: seen.extend(zip(texts, known[:, -1], strict=True)))
    toxicity.train(docs, labels, toxicity.default_categories(), **bounds)
    return sorted(seen)


def test_a_long_text_takes_no_other_texts_place(spark, monkeypatch):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.format_string("%02d", "id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    first = docs.orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("x"), 2000)).otherwise(F.col("text")))
    want = [(f"text {i:02d}", i % 2) for i in range(20) if i != first]
    assert sampled(monkeypatch, long, labels, max_bytes=1000) == want
    assert sampled(monkeypatch, long, labels, max_text=1000) == want
    with pytest.raises(ValueError):
        sampled(monkeypatch, docs, labels, max_text=3)


def test_labels_without_documents_take_no_place_and_repeats_count_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)] * 3 + [(0, "text 0 and more")], "doc_id bigint, text string")
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert sampled(monkeypatch, docs, labels, max_rows=5) == [(f"text {i}", i % 2) for i in range(5)]
    with pytest.raises(ValueError):
        sampled(monkeypatch, docs, labels.where("doc_id > 100"))
