"""Registered queries next to their SQL twins, and all of them on odd tables."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests import compare
from tests.conftest import DEFAULT_DATA
from tests.llm.test_search_words_trie import brute_trie
from trailtally.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, data, name):
    connection = compare.connect(data)
    df = QUERIES[name](spark, data)
    columns, rows = compare.spark_rows(df)
    expected_columns, expected = compare.sql_rows(connection, ORACLE_SQL[name])
    assert columns == expected_columns
    assert rows == expected
    assert rows or data != DEFAULT_DATA
    assert compare.spark_types(df) == compare.sql_types(connection, ORACLE_SQL[name])


def write_tables(folder, docs, labels, pages, vectors, turns):
    """Odd tables as parquet, with extra columns named like the operators' own."""
    n = len(docs)
    pq.write_table(pa.table({
        "doc_id": pa.array([d[0] for d in docs], pa.int64()),
        "text": pa.array([d[1] for d in docs], pa.string()),
        "lang": pa.array([d[2] for d in docs], pa.string()),
        "source": pa.array([None] * n, pa.string()),
        "n_chars": pa.array([None] * n, pa.int64()),
        "score": pa.array(["x"] * n), "node": pa.array([1.5] * n), "_id": pa.array([None] * n, pa.int32()),
        "ids": pa.array(["y"] * n), "label": pa.array([7] * n), "component": pa.array(["z"] * n),
        "n_lines": pa.array([True] * n), "bits": pa.array([[1]] * n), "k1": pa.array([0] * n),
        "n_dropped": pa.array([3] * n), "_r1": pa.array(["r"] * n), "_r2": pa.array([2.5] * n),
        "_doc": pa.array([{"text": 1}] * n), "_text": pa.array([9] * n),
    }), f"{folder}/documents.parquet")
    pq.write_table(pa.table({
        "doc_id": pa.array([x[0] for x in labels], pa.int64()),
        "quality": pa.array([x[1] for x in labels], pa.int32()),
        "toxic": pa.array([x[2] for x in labels], pa.int32()),
        "text": pa.array(["t"] * len(labels)), "label": pa.array([1] * len(labels)),
    }), f"{folder}/labels.parquet")
    pq.write_table(pa.table({
        "page_id": pa.array([p[0] for p in pages], pa.int64()),
        "url": pa.array([p[1] for p in pages], pa.string()),
        "html": pa.array([p[2] for p in pages], pa.string()),
        "host": pa.array([1] * len(pages)), "text": pa.array([2] * len(pages)), "n_chars": pa.array(["q"] * len(pages)),
    }), f"{folder}/pages.parquet")
    pq.write_table(pa.table({
        "vec_id": pa.array([v[0] for v in vectors], pa.int64()),
        "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())),
        "label": pa.array([v[2] for v in vectors], pa.int32()),
        "node": pa.array(["n"] * len(vectors)), "kept": pa.array([0] * len(vectors)),
        "dims": pa.array(["d"] * len(vectors)), "rank": pa.array([0.5] * len(vectors)),
    }), f"{folder}/embeddings.parquet")
    pq.write_table(pa.table({
        "conv_id": pa.array([t[0] for t in turns], pa.int64()),
        "turn": pa.array([t[1] for t in turns], pa.int64()),
        "role": pa.array([t[2] for t in turns], pa.string()),
        "text": pa.array([t[3] for t in turns], pa.string()),
        "depth": pa.array(["d"] * len(turns)), "k1": pa.array([0] * len(turns)), "words": pa.array([None] * len(turns), pa.int8()),
    }), f"{folder}/conversations.parquet")


LONG = "word other " * 30_000
ODD_DOCS = [
    (0, None, None), (1, "", "en"), (2, "  \n\t ", "en"), (3, "one", None), (3, "one", None), (None, "no id here", "en"),
    (4, LONG, "en"), (5, "a\x00b \x85 c\u00a0d \u2028 e", "xx"), (6, "É" * 50 + "\n" + "é" * 50, "fr"), (7, "\n\n\n", "de"),
    (8, "one", "de"), (9, "x" * 5000, "en"), (10, "*** | ### $$$ <b>", ""),
]
ODD_LABELS = [(0, 1, 0), (3, 0, 0), (3, 1, 1), (None, 1, 0), (4, None, None), (99, 1, 1), (8, 1, 0), (9, 0, 0)]
ODD_PAGES = [
    (0, None, None), (1, "", ""), (2, "http://A.Example.NET", "<p>"), (2, "http://A.Example.NET", "<p>"),
    (None, "nothing", "plain text"), (3, "://x/3", "</p></div><article>" + "<b>" * 500 + "deep"), (4, "a://b://c/d?e#f", "&lt;&#0;"),
]
ODD_VECTORS = [
    (0, None, 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [1.0, float("nan")], 1),
    (5, [1.0, float("inf")], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (8, [2.0, 0.0], 1),
    (None, [1.0, 0.0], 1), (9, [1.0, 0.0], 2), (10, [1.0], 1), (11, [-1.0, 0.0], 1), (12, [1e-38, 0.0], 1),
]
ODD_TURNS = [
    (0, None, None, None), (0, 0, "user", "a"), (0, 1, "user", LONG), (None, 0, "user", "b"), (None, None, None, None),
    *[(c, None, "user", "a") for c in range(1, 20)], (7, 3, "", ""), (7, 3, "", ""), (41, 0, "assistant", "\x85 \x00"),
]

ROWS = {
    "op1_quality_classifier": len(ODD_DOCS), "op2_sentencepiece": len(ODD_DOCS), "op3_url_filter": len(ODD_PAGES),
    "op4_lm_scoring": len(ODD_DOCS), "op5_packing": None, "op6_quality_rules": len(ODD_DOCS),
    "op7_html_extraction": len(ODD_PAGES), "op8_line_dedup": len(ODD_DOCS), "op9_embedding_dedup": len(ODD_VECTORS),
    "op10_near_dedup": len(ODD_DOCS), "op11_nearest_neighbours": 0, "op12_spelling_variants": 0,
    "op13_prefix_trie": len(brute_trie(ODD_TURNS)),
}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    write_tables(folder, ODD_DOCS, ODD_LABELS, ODD_PAGES, ODD_VECTORS, ODD_TURNS)
    return folder


@pytest.fixture(scope="module")
def nothing(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nothing"))
    write_tables(folder, [], [], [], [], [])
    return folder


def test_every_operator_is_registered():
    assert list(QUERIES) == sorted(ROWS, key=lambda name: int(name[2:].split("_")[0]))


@pytest.mark.parametrize("name", list(ROWS))
def test_odd_tables_keep_their_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if ROWS[name] is not None:
        assert len(rows) == ROWS[name]
    else:
        assert {row["doc_id"] for row in rows} == {doc[0] for doc in ODD_DOCS}


@pytest.mark.parametrize("name", list(ROWS))
def test_empty_tables_give_no_rows(spark, nothing, name):
    assert QUERIES[name](spark, nothing).collect() == []


def test_pipeline_on_odd_and_empty_tables(spark, odd, nothing):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, nothing).collect() == []
    assert isinstance(corpus_pipeline.run(spark, odd).collect(), list)


def test_stages_keep_other_columns(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    before = [row.asDict(True) for row in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, odd)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        for row in kept.collect():
            own = {k: v for k, v in row.asDict(True).items() if k not in ("text", "n_chars")}
            assert any(all(old[k] == v for k, v in own.items()) for old in before), name
        if name == "line_dedup":
            assert kept.count() == len(before)
