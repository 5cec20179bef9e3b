from __future__ import annotations

import collections

import corpus_pipeline
from trailtally.llm import near_dedup


def test_stages_each_take_effect(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            sizes.append(docs.count())
        if name == "line_dedup":
            kept = {row["doc_id"]: row for row in docs.collect()}
            for row in before.collect():
                lines = collections.Counter(row["text"].split("\n"))
                left = collections.Counter(kept[row["doc_id"]]["text"].split("\n"))
                # A document that loses all its lines has an empty text.
                assert not left - lines - collections.Counter([""])
                assert kept[row["doc_id"]]["n_chars"] == len(kept[row["doc_id"]]["text"])
        if name == "near_dedup":
            classes = near_dedup.near_duplicates(before)
            expected = {row["class_id"] for row in classes.collect()}
            assert {row["doc_id"] for row in docs.collect()} == expected
        if name == "packing":
            assert {row["doc_id"] for row in docs.collect()} == {row["doc_id"] for row in before.collect()}
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4]


def test_run_gives_the_rows_of_the_last_stage(spark, data):
    rows = corpus_pipeline.run(spark, data)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0
