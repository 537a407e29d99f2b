"""Strict JSON, masking and findings, and the stream of log lines."""

from __future__ import annotations

import pytest
from conftest import canonical, golden_records, rows_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayframe.functions.strictjson import is_canonical_line, strict_json
from assayframe.operators import findings, masking
from assayframe.streaming.tail import watch_lines

BAD_JSON = [
    "", "{", '{"a":1,"a":2}', '{"x":{"a":1,"a":1}}', '{"a":NaN}', '{"a":Infinity}', '{"a":-Infinity}', '{"a":1e999}', '{"a":-1e400}',
    '{"a":' + "9" * 65 + "}", '{"a":-' + "9" * 64 + "}", "{'a':1}", '{"a":1} x', '{"a":1},{"b":2}', '1,"w":2', "1] , [2", "1}, {2", None,
]
GOOD_JSON = [
    '{"a": [1, -2, 2.5, 1e5, 0.0, null, true], "b": "x"}', '{"n": ' + "9" * 18 + "}", '{"s":"1e999 NaN ' + "9" * 80 + '"}', '{"s":"quote \\" 1e999"}',
    '{"n":' + "9" * 30 + "}",
]


def test_strict_json(spark):
    df = spark.createDataFrame([(t,) for t in BAD_JSON + GOOD_JSON], "t string").select("t", strict_json("t").alias("ok"))
    got = rows_of(df)
    assert [t for t, ok in got if ok] == GOOD_JSON
    assert [t for t, ok in got if not ok] == BAD_JSON


def test_canonical_lines(spark):
    lines = ['{"a":1.0,"b":"é"}', '{"b":1,"a":2}', '{"a": 1}', '{"a":1e5}', '{"a":1.50}', '{"a":"\\u00e9"}', "x", '{"a":1}\r']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in lines], "t string").select(is_canonical_line("t")).collect()]
    assert got == [True] + [False] * 7


def run(length, alphabet="Ab3"):
    return (alphabet * length)[:length]


SECRETS = [
    "sk-" + run(24), "see sk-" + run(20) + " there", "ghp_" + run(36), "github_pat_" + run(22), "hf_" + run(30), "AIza" + run(35),
    "AKIA" + run(16, "AB3"), "xoxb-" + run(12), "-----BEGIN RSA " + "PRIVATE KEY-----", "Authorization: BEARER  " + run(20),
    ".".join(("eyJ" + run(10), run(8), "sig")), "(eyJ" + run(10) + "." + run(4) + ".)",
]
PLAIN = [
    "", "sk-short", "task-" + run(30), "risk_sk-" + "x", "aghp_" + run(40), "bearer of news", "eyJ.a.b", "version.eyJ" + run(10) + ".ab.b",
    "eyJ" + run(20) + ".e30", "AKIA" + run(10, "AB3"), 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
]


def test_value_shapes(spark):
    df = spark.createDataFrame([(t,) for t in SECRETS + PLAIN], "t string").select("t", masking.mask_text("t").alias("m"))
    got = rows_of(df)
    assert [m for _, m in got[: len(SECRETS)]] == [masking.MARKER] * len(SECRETS)
    assert [m for _, m in got[len(SECRETS):]] == PLAIN
    assert len(masking.VALUE_SHAPES) == len(masking.SHAPE_MARKS)


def test_names(spark):
    secret = ["secret", "clientSecret", "db-password", "PASSPHRASES", "my.credentials", "privateKey", "private_keys", "authorization",
              "auth_header", "oauth", "x_oauth_y", "apiKey", "API-KEY", "api_keys", "accessKey", "signing_key", "token", "hfToken", "pwd", "auth",
              "bearer", "auth_anything"]
    plain = ["tokens", "max_tokens", "token_budget", "key", "author", "author_name", "secretary", "api_key_count", "bearer_of", "keyboard"]
    df = spark.createDataFrame([(n,) for n in secret + plain], "n string").select("n", masking.is_secret_name("n").alias("s"))
    assert [n for n, s in rows_of(df) if s] == secret


def test_mask_nested_rows(spark):
    df = spark.sql(
        f"""SELECT named_struct('apiKey', 'v', 'note', 'fine', 'is_secret', true, 'deep', array('ok', '{SECRETS[0]}'), 'token', 5) AS meta,
        map('password', 'x', 'plain', '{SECRETS[2]}', 'other', 'y') AS m, 'kept' AS author, 7 AS tokens"""
    )
    row = masking.mask(df).first()
    assert row["meta"].asDict() == {"apiKey": masking.MARKER, "note": "fine", "is_secret": True, "deep": ["ok", masking.MARKER], "token": None}
    assert row["m"] == {"password": masking.MARKER, "plain": masking.MARKER, "other": "y"}
    assert (row["author"], row["tokens"]) == ("kept", 7)


EXPECTED = [
    ("exact", "p", "reproduce", 3.0, None, None), ("off", "p", "reproduce", 3.0, None, None), ("near", "p", "documented", 1.0, None, 0.5),
    ("far", "p", "documented", 1.0, None, 0.5), ("text", "p", "documented", None, None, None), ("empty", "p", "documented", None, None, None),
    ("absent", "p", "reproduce", 1.0, None, None), ("words", "p", "reproduce", None, "same", None), ("loose", "p", "documented", 1.0, None, None),
]
OBSERVED = [
    ("exact", 3.0, None), ("off", 3.0000001, None), ("near", 1.5, None), ("far", 1.5001, None), ("text", None, "said"), ("empty", None, ""),
    ("words", None, "same"), ("loose", 1.0, None),
]


def test_findings(spark):
    expected = spark.createDataFrame(EXPECTED, findings.EXPECTATIONS)
    observed = spark.createDataFrame(OBSERVED, "finding_id string, number double, text string")
    found = findings.evaluate_findings(expected, observed)
    assert dict(rows_of(found.select("finding_id", "status"))) == {
        "exact": "reproduced", "off": "FAILED", "near": "documented", "far": "FAILED", "text": "documented", "empty": "FAILED",
        "absent": "MISSING", "words": "reproduced", "loose": "FAILED",
    }
    assert rows_of(findings.verdict(found)) == [(9, 4, 1, True)]
    assert rows_of(findings.verdict(found.where("status = 'reproduced'"))) == [(2, 0, 0, False)]
    assert rows_of(findings.verdict(found.limit(0))) == [(0, 0, 0, False)]
    wrong = spark.createDataFrame([("x", "p", "guess", 1.0, None, None)], findings.EXPECTATIONS)
    with pytest.raises(PySparkException, match="unknown finding class: guess"):
        findings.evaluate_findings(wrong, spark.createDataFrame([("x", 1.0, None)], observed.schema)).collect()


def test_counts_name_their_population(spark):
    counts = spark.createDataFrame([("all", 1), (None, 2), ("other", 3)], "population string, n long")
    known = spark.createDataFrame([("all",)], "population string")
    assert sorted(r["n"] for r in findings.unnamed_populations(counts, known).collect()) == [2, 3]
    row = spark.range(4).agg(F.count("*").alias("n"), F.max("id").alias("top"))
    assert rows_of(findings.observed_numbers(row, {"rows": "n", "top": "top"})) == [("rows", 4.0, None), ("top", 3.0, None)]


def test_stream_of_log_lines(spark, tmp_path):
    logs, sink, state = tmp_path / "logs", str(tmp_path / "sink"), str(tmp_path / "state")
    logs.mkdir()
    lines = [canonical(r) for r in golden_records()]
    (logs / "a.jsonl").write_text("\n".join(lines) + "\n")
    (logs / "b.jsonl").write_text("\n".join([*lines[:3], lines[3] + " ", "{"]) + "\n")
    watch_lines(spark, str(logs), sink, state).awaitTermination(120)
    (logs / "c.jsonl").write_text('{"a":1,"a":2}\n')
    watch_lines(spark, str(logs), sink, state).awaitTermination(120)
    got = spark.read.parquet(sink).select(F.element_at(F.split("run_id", "/"), -1).alias("f"), "rule")
    assert sorted(rows_of(got)) == [
        ("b.jsonl", "line is not in canonical form"), ("b.jsonl", "line is not strict JSON"), ("c.jsonl", "line is not strict JSON"),
    ]
