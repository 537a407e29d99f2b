"""The pipeline and the registered queries on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from assayframe.llm.queries import ORACLES, QUERIES

SF_DIR = Path(driver.SMOKE_DIR)
pytestmark = pytest.mark.skipif(not SF_DIR.is_dir(), reason="the given tables are not here")


def test_names():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(QUERIES) <= set(driver.queries()) and "pipeline" in driver.queries()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "mixing", "encoding"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    given = {row["doc_id"]: row for row in docs.collect()}
    before = Counter(dict.fromkeys(given, 1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(SF_DIR)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        assert all(row == given[row["doc_id"]] for row in rows)
        after = Counter(row["doc_id"] for row in rows)
        if name == "mixing":
            assert set(after) <= set(before) and max(after.values()) == 2
            words = {key: len(given[key]["text"].split()) for key in before}
            assert abs(sum(words[key] * n for key, n in after.items()) / (1.5 * sum(words.values())) - 1) < 0.1
        else:
            assert not after - before and sum(after.values()) >= 0.85 * sum(before.values())
        before = after
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF_DIR))
    assert Counter(row["doc_id"] for row in encoded.select("doc_id").collect()) == before


def test_run_of_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(SF_DIR))
    cursor = db.execute(ORACLES[name])
    order = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(row[i] for i in order) for row in cursor.fetchall()), key=repr)
