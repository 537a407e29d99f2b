"""Registered queries: payload rules, findings, masking and file audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions.strictjson import strict_json
from assayframe.operators import findings, logchecks, masking
from assayframe.operators.filters import core_triple
from assayframe.plans.registering import Shelf
from assayframe.plans.tables import MEASURED, MEASUREMENTS, SQL_TRIPLE, TRIPLE, measurements, table
from assayframe.sources.manifest import audit_files, parse_manifest
from assayframe.sources.registry import registry_violations

SHELF = Shelf()
query = SHELF.query


@query(
    "payload_checks",
    """WITH p AS (SELECT user_id AS run_id, event_id AS seq, event_type, value, try_cast(json_extract(props, '$.k') AS BIGINT) AS k,
    json_valid(props) AND json_keys(props) = ['k'] AS shaped FROM events)
SELECT run_id, seq, 'payload members' AS rule, event_type AS detail FROM p WHERE NOT shaped
UNION ALL SELECT run_id, seq, 'k must be at least 10', event_type FROM p WHERE k < 10
UNION ALL SELECT run_id, seq, 'an error carries no large value', event_type FROM p WHERE event_type = 'error' AND value > 30""",
)
def payload_checks(spark, sf_dir):
    props = F.col("props")
    k = F.get_json_object(props, "$.k").try_cast("bigint")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "event_type", "value", "props")
    return logchecks.violations(
        rows,
        {
            "payload is not strict JSON": ~strict_json(props),
            "payload members": ~logchecks.has_members(props, F.array(F.lit("k"))),
            "k must be at least 10": k < 10,
            "an error carries no large value": (F.col("event_type") == "error") & (F.col("value") > 30),
        },
        F.col("event_type"),
    )


@query(
    "strict_json_texts",
    " UNION ALL ".join(
        f"SELECT '{name}' AS source, count(*) AS n_rows, count(*) FILTER (WHERE json_valid({column})) AS n_strict FROM {name}"
        for name, column in (("events", "props"), ("documents", "text"), ("conversations", "text"), ("pages", "html"))
    ),
)
def strict_json_texts(spark, sf_dir):
    parts = [
        table(spark, sf_dir, name).agg(F.count("*").alias("n_rows"), F.count_if(strict_json(column)).alias("n_strict"))
        .select(F.lit(name).alias("source"), "n_rows", "n_strict")
        for name, column in (("events", "props"), ("documents", "text"), ("conversations", "text"), ("pages", "html"))
    ]
    return findings.observations(*parts)


# finding, population, class, expected, tolerance; shares, so that they hold at every scale
_EXPECTED = [
    ("share_tax_present", "all rows", "documented", 0.889, 0.01),
    ("share_core_triple", "all rows", "documented", 0.5, 0.01),
    ("share_flagged", "core triple", "documented", 0.4987, 0.02),
    ("smallest_tax", "all rows", "reproduce", 0.01, None),
    ("largest_quantity", "all rows", "reproduce", 49.0, None),
    ("labels", "all rows", "documented", None, None),
    ("not_measured", "all rows", "reproduce", 1.0, None),
]

_FINDINGS = f"""{MEASUREMENTS}, o AS (
  SELECT count(tax) / count(*)::DOUBLE AS share_tax_present, count(*) FILTER (WHERE {SQL_TRIPLE}) / count(*)::DOUBLE AS share_core_triple,
         count(*) FILTER (WHERE {SQL_TRIPLE} AND flag) / count(*) FILTER (WHERE {SQL_TRIPLE})::DOUBLE AS share_flagged,
         min(tax) AS smallest_tax, max(quantity) AS largest_quantity FROM measurements),
seen AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS finding_id, {n} AS seen FROM o" for n in (
    "share_tax_present", "share_core_triple", "share_flagged", "smallest_tax", "largest_quantity")) + """),
expected(finding_id, population, cls, number, tolerance) AS (VALUES """ + ", ".join(
    f"('{f}', '{p}', '{c}', {'NULL' if e is None else e}::DOUBLE, {'NULL' if t is None else t}::DOUBLE)" for f, p, c, e, t in _EXPECTED
) + """),
found AS (SELECT e.finding_id, population, cls, number AS expected, seen AS observed, tolerance,
  CASE WHEN e.finding_id = 'labels' THEN 'documented' WHEN seen IS NULL THEN 'MISSING'
       WHEN cls = 'reproduce' THEN CASE WHEN seen = number THEN 'reproduced' ELSE 'FAILED' END
       WHEN abs(seen - number) <= tolerance THEN 'documented' ELSE 'FAILED' END AS status
  FROM expected e LEFT JOIN seen s ON e.finding_id = s.finding_id)"""


def _findings(spark, sf_dir):
    rows = measurements(spark, sf_dir)
    triple = core_triple(MEASURED, TRIPLE)
    shares = rows.agg(
        (F.count("tax") / F.count("*")).alias("share_tax_present"), (F.count_if(triple) / F.count("*")).alias("share_core_triple"),
        (F.count_if(triple & F.col("flag")) / F.count_if(triple)).alias("share_flagged"),
    )
    extremes = rows.agg(F.min("tax").alias("smallest_tax"), F.max("quantity").alias("largest_quantity"))
    labels = rows.agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("text")).select(
        F.lit("labels").alias("finding_id"), F.lit(None).cast("double").alias("number"), "text"
    )
    observed = findings.observations(
        findings.observed_numbers(shares, {name: name for name in shares.columns}),
        findings.observed_numbers(extremes, {name: name for name in extremes.columns}),
        labels,
    )
    expected = spark.createDataFrame([(f, p, c, e, None, t) for f, p, c, e, t in _EXPECTED], findings.EXPECTATIONS)
    return findings.evaluate_findings(expected, observed)


@query(
    "expectation_findings",
    f"WITH {_FINDINGS} SELECT finding_id, population, cls, expected, round(observed, 9) AS observed, tolerance, status FROM found",
)
def expectation_findings(spark, sf_dir):
    return _findings(spark, sf_dir).withColumn("observed", F.round("observed", 9))


@query(
    "verdict",
    f"""WITH {_FINDINGS} SELECT count(*) AS n_findings, count(*) FILTER (WHERE status = 'FAILED') AS n_failed,
  count(*) FILTER (WHERE status = 'MISSING') AS n_missing, bool_or(status IN ('FAILED', 'MISSING')) AS fails FROM found""",
)
def verdict(spark, sf_dir):
    return findings.verdict(_findings(spark, sf_dir))


@query(
    "unnamed_populations",
    """SELECT l_returnflag AS population, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') GROUP BY 1""",
)
def unnamed_populations(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("population")).agg(F.count("*").alias("n"))
    return findings.unnamed_populations(counts, spark.createDataFrame([("A",), ("R",)], "population string"))


_BRANDS = [f"Brand#{i}" for i in range(1, 27)]


@query(
    "registry_audit",
    """WITH r AS (SELECT p_brand AS key, count(*) AS n, min(p_size) AS low, CASE WHEN max(p_size) < 50 THEN NULL ELSE max(p_size) END AS high FROM part GROUP BY 1),
e AS (SELECT 'Brand#' || unnest(range(1, 27)) AS key)
SELECT key, 'range must be an ordered pair' AS rule FROM r WHERE high IS NULL
UNION ALL SELECT key, 'unverified unit needs a note' FROM r WHERE low > 1
UNION ALL SELECT key, 'role is not known' FROM r WHERE n % 2 = 1
UNION ALL SELECT key, 'key is missing' FROM e ANTI JOIN r USING (key)
UNION ALL SELECT key, 'key is not expected' FROM r ANTI JOIN e USING (key)""",
)
def registry_audit(spark, sf_dir):
    """A registry derived from the parts, one entry per brand, whose entries break several rules."""
    size = F.col("p_size").cast("double")
    entries = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(
        F.min(size).alias("low"), F.when(F.max(size) >= 50, F.max(size)).alias("high"), F.count("*").alias("n")
    ).select(
        "key", F.translate("key", "#", "_").alias("column"), F.lit("cm").alias("unit"),
        F.when(F.col("low") > 1, "unverified").otherwise("verified").alias("unit_status"), F.lit(None).cast("string").alias("unit_note"),
        F.when(F.col("n") % 2 == 1, "guess").otherwise("validator").alias("role"), "low", "high",
        F.lit(None).cast("boolean").alias("keep_flag"), F.lit(None).cast("array<double>").alias("ladder"),
    )
    return registry_violations(entries, _BRANDS)


_SHAPES_SQL = "|".join(f"(?:{shape})" for shape in masking.VALUE_SHAPES)


@query(
    "mask_secrets",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS source, {group} AS part, count(*) AS n_rows, count(*) FILTER (WHERE secret) AS n_masked,
  sum(CASE WHEN secret THEN 14 ELSE length({text}) END)::BIGINT AS n_chars
FROM (SELECT *, regexp_matches({text}, '{_SHAPES_SQL}') AS secret FROM {name}) GROUP BY 2"""
        for name, group, text in (("documents", "lang", "text"), ("conversations", "role", "text"))
    ),
)
def mask_secrets(spark, sf_dir):
    parts = []
    for name, group in (("documents", "lang"), ("conversations", "role")):
        rows = table(spark, sf_dir, name).select(F.col(group).alias("part"), masking.mask_text("text").alias("text"))
        parts.append(
            rows.groupBy("part").agg(
                F.count("*").alias("n_rows"), F.count_if(F.col("text") == masking.MARKER).alias("n_masked"),
                F.sum(F.length("text")).alias("n_chars"),
            ).select(F.lit(name).alias("source"), "*")
        )
    return findings.observations(*parts)




@query(
    "mask_named_values",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'author_name' WHEN 'system' THEN 'apiKey' ELSE 'max_tokens' END AS name,
  CASE WHEN role = 'system' THEN '***REDACTED***' ELSE text END AS value FROM conversations""",
)
def mask_named_values(spark, sf_dir):
    """Texts filed under a name that follows the speaker: one of the names is a credential's."""
    name = F.when(F.col("role") == "user", "author_name").when(F.col("role") == "system", "apiKey").otherwise("max_tokens")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", masking.mask_map(F.create_map(name, F.col("text"))).alias("m"))
    return rows.select("conv_id", "turn", F.explode("m").alias("name", "value"))


@query(
    "text_manifest_audit",
    """WITH d AS (SELECT doc_id, 'doc-' || doc_id AS own, CASE WHEN doc_id % 11 = 3 THEN 'gone-' || doc_id ELSE 'doc-' || doc_id END AS name,
    sha256(text) AS real_hash, strlen(text) AS real_bytes,
    CASE WHEN doc_id % 7 = 2 THEN sha256(text || 'x') ELSE sha256(text) END AS sha256, strlen(text) + CASE WHEN doc_id % 13 = 5 THEN 1 ELSE 0 END AS n_bytes
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT name, sha256, n_bytes, CASE WHEN n_bytes = 0 THEN 'malformed' WHEN name <> own THEN 'absent' WHEN sha256 = real_hash AND n_bytes = real_bytes THEN 'verified' ELSE 'mismatch' END AS status FROM d""",
)
def text_manifest_audit(spark, sf_dir):
    """Document texts against manifest lines that misstate some hashes and sizes and name some texts that are not there; an empty text makes a malformed line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key, text = F.col("doc_id"), F.col("text")
    digest = F.sha2(F.when(key % 7 == 2, F.concat(text, F.lit("x"))).otherwise(text).cast("binary"), 256)
    size = F.octet_length(text) + F.when(key % 13 == 5, 1).otherwise(0)
    name = F.concat(F.when(key % 11 == 3, "gone-").otherwise("doc-"), key.cast("string"))
    lines = docs.select(F.concat_ws("  ", digest, size.cast("string"), name).alias("value"))
    observed = docs.select(
        F.concat(F.lit("doc-"), key.cast("string")).alias("name"), F.sha2(text.cast("binary"), 256).alias("sha256"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return audit_files(parse_manifest(lines, strict=False), observed).select("name", "sha256", "n_bytes", "status")
