"""Registered queries: identity, filters, candidates and profiles of the measurement rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.columns import content_id, normalise_label
from assayframe.operators import candidates as cand
from assayframe.operators import filters, findings, identity, populations, profile
from assayframe.plans.registering import Shelf
from assayframe.plans.rounding import rounded
from assayframe.plans.tables import CANDIDATE_KEY, MEASURED, MEASUREMENTS, SQL_TRIPLE, TRIPLE, measurements, row_bound, table
from assayframe.sources.measurements import load_accounting, nans_to_null, with_row_index
from assayframe.sources.storage import write_shared

SHELF = Shelf()
query = SHELF.query
PROPERTIES = MEASURED.columns()


def _candidate_sql(source: str = "measurements", key: str = "candidate_id", where: str = "true") -> str:
    stats = ", ".join(
        f"median({p}) AS {p}_median, count({p}) AS {p}_n, min({p}) AS {p}_min, max({p}) AS {p}_max, stddev_samp({p}) AS {p}_std"
        for p in PROPERTIES
    )
    return f"SELECT {key}, count(*) AS n_rows, {stats} FROM {source} WHERE {where} GROUP BY {key}"


_BUILD_SQL = f"""WITH {MEASUREMENTS}, c AS ({_candidate_sql()}),
names AS (SELECT candidate_id, min(l_partkey) AS l_partkey, coalesce(min(label), 'unknown') AS label FROM measurements GROUP BY 1)
SELECT candidate_id, l_partkey, label, n_rows, """ + ", ".join(
    f"{p}_n, {p}_min, {p}_max, round({p}_median, 6) AS {p}_median, round({p}_std, {3 if p == 'price' else 6}) AS {p}_std" for p in PROPERTIES
) + " FROM c JOIN names USING (candidate_id)"


def _build(spark: SparkSession, sf_dir: str, bound: int | None, hot_rows: int | None = None) -> DataFrame:
    rows = measurements(spark, sf_dir)
    built = cand.build_candidates(rows, PROPERTIES, key=CANDIDATE_KEY, rows_bound=bound, hot_rows=hot_rows)
    named = cand.with_candidate_id(built, "l_partkey", "tidy_label").withColumnRenamed("tidy_label", "label")
    return rounded(named, price_std=3)


@query("candidate_build", _BUILD_SQL)
def candidate_build(spark, sf_dir):
    return _build(spark, sf_dir, row_bound(spark, sf_dir, "lineitem"))


@query("candidate_build_chunked", _BUILD_SQL)
def candidate_build_chunked(spark, sf_dir):
    """Candidates of more than eight rows count as hot and are ranked in chunks."""
    return _build(spark, sf_dir, None, hot_rows=8)


@query(
    "scope_reject_accounting",
    """SELECT *, source_rows - excluded_second - excluded_reject = in_scope_rows AS balanced FROM (
  SELECT count(*) AS source_rows, count(second) AS excluded_second,
         count(*) FILTER (WHERE second IS NULL AND key IS NULL) AS excluded_reject,
         count(*) FILTER (WHERE second IS NULL AND key IS NOT NULL) AS in_scope_rows
  FROM (SELECT CASE WHEN l_linenumber = 7 THEN l_suppkey END AS second,
               CASE WHEN NOT (l_tax = 0.08 AND l_discount = 0.1) THEN l_partkey END AS key FROM lineitem))""",
)
def scope_reject_accounting(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    second = F.when(F.col("l_linenumber") == 7, F.col("l_suppkey"))
    key = F.when(~((F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)), F.col("l_partkey"))
    return load_accounting(lines, second, key)


_RANGES = {e.key: (e.column, e.low, e.high) for e in MEASURED.entries}
_RANGE_SQL = f"WITH {MEASUREMENTS} " + " UNION ALL ".join(
    f"SELECT '{k}' AS property, count(*) FILTER (WHERE {c} BETWEEN {lo} AND {hi}) AS inside, "
    f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS outside, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM measurements"
    for k, (c, lo, hi) in _RANGES.items()
)


@query("range_audit", _RANGE_SQL)
def range_audit(spark, sf_dir):
    return profile.range_audit(measurements(spark, sf_dir), MEASURED)


@query("range_audit_long", _RANGE_SQL)
def range_audit_long(spark, sf_dir):
    return profile.range_audit_long(measurements(spark, sf_dir), MEASURED.frame(spark), PROPERTIES)


@query(
    "window_audit",
    f"WITH {MEASUREMENTS} SELECT count(discount) AS present, count(*) FILTER (WHERE discount BETWEEN 0.02 AND 0.09) AS inside, "
    "count(*) FILTER (WHERE discount < 0.02 OR discount > 0.09) AS outside FROM measurements",
)
def window_audit(spark, sf_dir):
    return profile.window_audit(measurements(spark, sf_dir), MEASURED.by_key("discount"))


@query(
    "coverage",
    f"WITH {MEASUREMENTS} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS property, count({c}) AS n_rows, round(100.0 * count({c})::DOUBLE / count(*), 2) AS pct FROM measurements"
        for k, (c, _, _) in _RANGES.items()
    ),
)
def coverage(spark, sf_dir):
    return profile.coverage(measurements(spark, sf_dir), MEASURED)


def _steps_sql(steps: dict[str, str]) -> str:
    return f"WITH {MEASUREMENTS} " + " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS step, count(*) FILTER (WHERE {test}) AS n_rows FROM measurements"
        for i, (name, test) in enumerate(steps.items())
    )


@query(
    "filter_ladder",
    _steps_sql(
        {
            "all rows": "true", "tax present": "tax IS NOT NULL", "quantity present": "tax IS NOT NULL AND quantity IS NOT NULL",
            "quantity in range": "tax IS NOT NULL AND quantity BETWEEN 2 AND 45",
            "discount in range": "tax IS NOT NULL AND quantity BETWEEN 2 AND 45 AND discount BETWEEN 0.02 AND 0.09",
        }
    ),
)
def filter_ladder(spark, sf_dir):
    return filters.triple_ladder(measurements(spark, sf_dir), MEASURED, TRIPLE)


_CEILINGS = (10.0, 30.0, 100.0)


@query(
    "ceiling_ladder",
    _steps_sql(
        {"quantity present": "tax IS NOT NULL AND discount BETWEEN 0.02 AND 0.09 AND quantity IS NOT NULL"}
        | {f"quantity <= {c:g}": f"tax IS NOT NULL AND discount BETWEEN 0.02 AND 0.09 AND quantity <= {c}" for c in _CEILINGS}
    ),
)
def ceiling_ladder(spark, sf_dir):
    return filters.ceiling_ladder(measurements(spark, sf_dir), MEASURED, TRIPLE, _CEILINGS)


@query(
    "rung_ladder",
    f"WITH {MEASUREMENTS} SELECT rung, count(*) FILTER (WHERE {SQL_TRIPLE} AND tax <= rung) AS n_rows "
    "FROM measurements, (SELECT unnest([0.02, 0.04, 0.06, 0.08])::DOUBLE AS rung) GROUP BY rung",
)
def rung_ladder(spark, sf_dir):
    rows = measurements(spark, sf_dir)
    return filters.rung_ladder(rows, filters.core_triple(MEASURED, TRIPLE), "tax", MEASURED.by_key("discount"))


@query(
    "flag_audit",
    f"WITH {MEASUREMENTS} SELECT count(*) FILTER (WHERE f) AS n_true, count(*) FILTER (WHERE NOT f) AS n_false, "
    "count(*) FILTER (WHERE f IS NULL) AS n_missing FROM (SELECT CASE WHEN tax IS NOT NULL THEN flag END AS f FROM measurements)",
)
def flag_audit(spark, sf_dir):
    rows = measurements(spark, sf_dir).withColumn("flag", F.when(F.col("tax").isNotNull(), F.col("flag")))
    return filters.flag_counts(rows, "flag")


@query(
    "flagged_population",
    f"WITH {MEASUREMENTS} SELECT count(*) FILTER (WHERE {SQL_TRIPLE}) AS triple, "
    f"count(*) FILTER (WHERE {SQL_TRIPLE} AND flag) AS triple_and_flag FROM measurements",
)
def flagged_population(spark, sf_dir):
    triple, keep = filters.core_triple(MEASURED, TRIPLE), filters.passes_flag(MEASURED, "flag")
    return measurements(spark, sf_dir).agg(F.count_if(triple).alias("triple"), F.count_if(triple & keep).alias("triple_and_flag"))


_RESOLVED = f"""WITH {MEASUREMENTS}, evidence AS (
  SELECT l_orderkey, min(label) AS sole FROM measurements GROUP BY 1 HAVING count(DISTINCT label) = 1),
resolved AS (SELECT m.*, coalesce(label, sole, 'unknown') AS resolved_label FROM measurements m LEFT JOIN evidence USING (l_orderkey))"""


@query(
    "label_resolution",
    _RESOLVED + """ SELECT l_orderkey, l_linenumber, l_partkey, coalesce(label, 'unknown') AS label_raw, resolved_label,
  substr(sha256(l_orderkey::VARCHAR || '|' || resolved_label), 1, 16) AS candidate_id FROM resolved""",
)
def label_resolution(spark, sf_dir):
    resolved = identity.resolve_labels(measurements(spark, sf_dir), "l_orderkey", "label")
    return resolved.select(
        "l_orderkey", "l_linenumber", "l_partkey", normalise_label("label").alias("label_raw"), "resolved_label",
        content_id("l_orderkey", "resolved_label").alias("candidate_id"),
    )


_AUDIT_SQL = _RESOLVED + """ SELECT resolved_label AS outcome, count(*) AS n FROM resolved WHERE label IS NULL GROUP BY 1
  UNION ALL SELECT '(empty rows)', count(*) FROM resolved WHERE label IS NULL
  UNION ALL SELECT '(keys with several labels)', count(*) FROM (SELECT l_orderkey FROM resolved GROUP BY 1 HAVING count(DISTINCT label) > 1)"""


@query("label_audit", _AUDIT_SQL)
def label_audit(spark, sf_dir):
    rows = measurements(spark, sf_dir).select("l_orderkey", "label")
    return identity.label_resolution_audit(identity.resolve_labels(rows, "l_orderkey", "label"), key="l_orderkey", label="label")


@query(
    "row_index",
    "SELECT l_orderkey, l_linenumber, row_number() OVER () - 1 AS row_index FROM lineitem",
)
def row_index(spark, sf_dir):
    """The place of every line in its source."""
    return with_row_index(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


@query(
    "missing_numbers",
    """SELECT l_suppkey, count(nullif(l_tax, 0.0)) AS n, median(nullif(l_tax, 0.0)) AS middle, max(nullif(l_tax, 0.0)) AS highest FROM lineitem GROUP BY 1""",
)
def missing_numbers(spark, sf_dir):
    """NaN planted for a zero counts as missing everywhere, as NULL does in SQL."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"))
    return nans_to_null(lines).groupBy("l_suppkey").agg(
        F.count("tax").alias("n"), F.median("tax").alias("middle"), F.max("tax").alias("highest")
    )


@query("label_audit_by_row_index", _AUDIT_SQL)
def label_audit_by_row_index(spark, sf_dir):
    """The same for a resolved table that lost its source labels: they come back by row index."""
    source = with_row_index(measurements(spark, sf_dir).select("l_orderkey", "label"))
    resolved = identity.resolve_labels(source, "l_orderkey", "label").drop("label")
    back = identity.with_source_label(resolved, source, index="row_index", label="label")
    return identity.label_resolution_audit(back, key="l_orderkey", label="source_label")


@query(
    "observed_labels",
    f"WITH {MEASUREMENTS} SELECT l_orderkey, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels FROM measurements GROUP BY 1",
)
def observed_labels(spark, sf_dir):
    found = identity.observed_labels(measurements(spark, sf_dir), "l_orderkey", "label")
    return found.select("l_orderkey", F.array_join("labels", ",").alias("labels"))


@query(
    "multi_label_keys",
    f"""WITH {MEASUREMENTS} SELECT count(*) FILTER (WHERE n + u > 1) AS with_unknown, count(*) FILTER (WHERE n > 1) AS without_unknown,
  count(*) FILTER (WHERE n > 0 AND u > 0) AS unknown_twins
  FROM (SELECT count(DISTINCT label) AS n, max(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS u FROM measurements GROUP BY l_orderkey)""",
)
def multi_label_keys(spark, sf_dir):
    return identity.multi_label_keys(measurements(spark, sf_dir), "l_orderkey", "label")


@query(
    "unknown_twin_keys",
    f"WITH {MEASUREMENTS} SELECT l_orderkey FROM measurements WHERE label IS NULL INTERSECT SELECT l_orderkey FROM measurements WHERE label IS NOT NULL",
)
def unknown_twin_keys(spark, sf_dir):
    return identity.unknown_twin_keys(measurements(spark, sf_dir), "l_orderkey", "label")


@query(
    "label_frequency",
    f"WITH {MEASUREMENTS} SELECT coalesce(label, 'unknown') AS label, count(*) AS n_rows FROM measurements GROUP BY 1",
)
def label_frequency(spark, sf_dir):
    return identity.label_frequency(measurements(spark, sf_dir), "label")


@query(
    "structure_key_merge",
    """SELECT raw_texts, structure_keys, raw_texts - structure_keys AS merged FROM (
  SELECT count(DISTINCT raw) AS raw_texts,
         count(DISTINCT array_to_string(list_sort(list_filter(string_split_regex(lower(trim(raw)), '\\s+'), lambda w: w <> '')), ' ')) AS structure_keys
  FROM (SELECT CASE WHEN p_size > 25 THEN p_name ELSE string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] END AS raw FROM part))""",
)
def structure_key_merge(spark, sf_dir):
    words = F.split("p_name", " ")
    raw = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat_ws(" ", words[1], words[0]))
    parts = table(spark, sf_dir, "part").select(raw.alias("raw"))
    keyed = identity.with_structure_key(parts, "raw", expensive=True)
    return identity.raw_merges(keyed, "raw", "structure_key")


def _candidates(spark: SparkSession, sf_dir: str, bound: int | None) -> DataFrame:
    return cand.build_candidates(measurements(spark, sf_dir), PROPERTIES, key=CANDIDATE_KEY, rows_bound=bound)


_SIZES = f"WITH {MEASUREMENTS}, c AS (SELECT candidate_id, count(*) AS n_rows FROM measurements GROUP BY 1) "


@query(
    "replicate_structure",
    _SIZES + "SELECT count(*) AS n_candidates, count(*) FILTER (WHERE n_rows >= 2) AS n_multi_row, "
    "coalesce(sum(n_rows) FILTER (WHERE n_rows >= 2), 0)::BIGINT AS rows_in_multi_row, max(n_rows) AS max_rows FROM c",
)
def replicate_structure(spark, sf_dir):
    return cand.replicate_structure(cand.build_candidates(measurements(spark, sf_dir), [], key=CANDIDATE_KEY, rows_bound=row_bound(spark, sf_dir, "lineitem")))


@query("size_histogram", _SIZES + "SELECT n_rows, count(*) AS n_candidates FROM c GROUP BY 1")
def size_histogram(spark, sf_dir):
    return cand.size_histogram(cand.build_candidates(measurements(spark, sf_dir), [], key=CANDIDATE_KEY, rows_bound=row_bound(spark, sf_dir, "lineitem")))


@query(
    "version_split",
    f"""WITH {MEASUREMENTS} SELECT count(*) FILTER (WHERE same) AS same_version, count(*) FILTER (WHERE NOT same) AS cross_version FROM (
  SELECT count(DISTINCT l_linestatus) + max(CASE WHEN l_linestatus IS NULL THEN 1 ELSE 0 END) <= 1
     AND count(DISTINCT label) + max(CASE WHEN label IS NULL THEN 1 ELSE 0 END) <= 1 AS same
  FROM measurements GROUP BY l_orderkey HAVING count(*) >= 2)""",
)
def version_split(spark, sf_dir):
    return cand.version_split(measurements(spark, sf_dir), ["l_linestatus", "label", "not_there"], key="l_orderkey")


@query(
    "rows_of_replicated",
    _SIZES + "SELECT l_linestatus, count(*) AS n_rows FROM measurements SEMI JOIN (SELECT candidate_id FROM c WHERE n_rows >= 2) USING (candidate_id) GROUP BY 1",
)
def rows_of_replicated(spark, sf_dir):
    rows = measurements(spark, sf_dir)
    sizes = cand.build_candidates(rows, [], key=CANDIDATE_KEY, rows_bound=row_bound(spark, sf_dir, "lineitem"))
    return cand.rows_of_replicated(rows, sizes, key=CANDIDATE_KEY).groupBy("l_linestatus").agg(F.count("*").alias("n_rows"))


def _noise_sql(where: str = "true") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{p}' AS property, {p}_std AS s, abs({p}_median) AS m FROM c WHERE {p}_n >= 2" for p in PROPERTIES
    )
    return f"""WITH {MEASUREMENTS}, c AS ({_candidate_sql(where=where)}), long AS ({parts})
SELECT property, count(*) AS n_groups, round(median(s), 6) AS median_abs_std,
       round(median(CASE WHEN m > 0 THEN s / m END), 6) AS median_rel_std,
       round(quantile_cont(CASE WHEN m > 0 THEN s / m END, 0.9), 6) AS p90_rel_std
FROM long GROUP BY 1"""


@query("noise_floor", _noise_sql())
def noise_floor(spark, sf_dir):
    bound = row_bound(spark, sf_dir, "lineitem")
    return rounded(cand.noise_floor(_candidates(spark, sf_dir, bound), PROPERTIES, rows_bound=bound))


@query("noise_floor_chunked", _noise_sql())
def noise_floor_chunked(spark, sf_dir):
    """Every property counts as a hot group of candidates."""
    return rounded(cand.noise_floor(_candidates(spark, sf_dir, None), PROPERTIES, hot_rows=100))


@query("noise_floor_filtered", _noise_sql(SQL_TRIPLE))
def noise_floor_filtered(spark, sf_dir):
    mask = filters.core_triple(MEASURED, TRIPLE)
    bound = row_bound(spark, sf_dir, "lineitem")
    return rounded(cand.noise_floor_on_rows(measurements(spark, sf_dir), mask, PROPERTIES, key=CANDIDATE_KEY, rows_bound=bound))


@query(
    "identity_residual",
    f"""WITH {MEASUREMENTS} SELECT count(*) AS n_rows, round(max(r), 6) AS max_residual, round(median(r), 6) AS median_residual
FROM (SELECT abs(price - (quantity - 1.0 + discount * discount)) AS r FROM measurements WHERE discount IS NOT NULL AND price IS NOT NULL AND quantity IS NOT NULL)""",
)
def identity_residual(spark, sf_dir):
    bound = row_bound(spark, sf_dir, "lineitem")
    return rounded(profile.identity_residual(measurements(spark, sf_dir), "price", "quantity", "discount", rows_bound=bound))


@query("column_minimum", f"WITH {MEASUREMENTS} SELECT min(tax) AS minimum FROM measurements")
def column_minimum(spark, sf_dir):
    return profile.column_minimum(measurements(spark, sf_dir), "tax")


@query(
    "violation_share",
    f"""WITH {MEASUREMENTS} SELECT violations, population, CASE WHEN population > 0 THEN round(100.0::DOUBLE * violations / population, 2) ELSE 0.0 END AS pct
FROM (SELECT count(*) FILTER (WHERE quantity < l_linenumber * l_linenumber) AS violations, count(*) AS population FROM measurements WHERE {SQL_TRIPLE})""",
)
def violation_share(spark, sf_dir):
    return profile.violation_share(measurements(spark, sf_dir), filters.core_triple(MEASURED, TRIPLE), "quantity", "l_linenumber")


_PAIRS = (("tax", "discount"), ("quantity", "price"), ("tax", "price"), ("discount", "quantity"))
_SPEARMAN = f"WITH {MEASUREMENTS} " + " UNION ALL ".join(
    f"""SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr(rx, ry), 9) AS spearman FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS rx,
         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS ry
  FROM measurements WHERE {SQL_TRIPLE} AND {a} IS NOT NULL AND {b} IS NOT NULL)"""
    for a, b in _PAIRS
)


@query("rank_correlation", _SPEARMAN)
def rank_correlation(spark, sf_dir):
    bound = row_bound(spark, sf_dir, "lineitem")
    mask = filters.core_triple(MEASURED, TRIPLE)
    return rounded(profile.rank_correlation(measurements(spark, sf_dir), mask, _PAIRS, rows_bound=bound), 9)


@query("rank_correlation_chunked", _SPEARMAN)
def rank_correlation_chunked(spark, sf_dir):
    mask = filters.core_triple(MEASURED, TRIPLE)
    return rounded(profile.rank_correlation(measurements(spark, sf_dir), mask, _PAIRS), 9)


@query(
    "quantile_window",
    f"""WITH {MEASUREMENTS}, kept AS (SELECT * FROM measurements WHERE {SQL_TRIPLE}),
q AS (SELECT quantile_cont(price, 0.9) AS hi, quantile_cont(quantity, 0.25) AS lo FROM kept)
SELECT n_rows, population, round(100.0::DOUBLE * n_rows / population, 2) AS pct FROM (
  SELECT count(*) FILTER (WHERE price >= hi AND quantity <= lo) AS n_rows, count(*) AS population FROM kept, q)""",
)
def quantile_window(spark, sf_dir):
    mask = filters.core_triple(MEASURED, TRIPLE)
    bound = row_bound(spark, sf_dir, "lineitem")
    return profile.quantile_window(measurements(spark, sf_dir), mask, ("price", 0.9), ("quantity", 0.25), rows_bound=bound)


_DESCRIBE = f"""WITH {MEASUREMENTS} SELECT round(median(price), 6) AS median, round(quantile_cont(price, 0.95), 6) AS p95,
  round(quantile_cont(price, 0.99), 6) AS p99, max(price) AS maximum FROM measurements"""


@query("descriptives", _DESCRIBE)
def descriptives(spark, sf_dir):
    return rounded(profile.descriptives(measurements(spark, sf_dir), "price", rows_bound=row_bound(spark, sf_dir, "lineitem")))


@query("descriptives_chunked", _DESCRIBE)
def descriptives_chunked(spark, sf_dir):
    """The ranks by radix selection."""
    return rounded(profile.descriptives(measurements(spark, sf_dir), "price"))


@query(
    "population_medians",
    f"WITH {MEASUREMENTS} SELECT round(median(price), 6) AS median_all, round(median(CASE WHEN {SQL_TRIPLE} THEN price END), 6) AS median_masked FROM measurements",
)
def population_medians(spark, sf_dir):
    mask = filters.core_triple(MEASURED, TRIPLE)
    bound = row_bound(spark, sf_dir, "lineitem")
    return rounded(profile.population_medians(measurements(spark, sf_dir), mask, "price", rows_bound=bound))


_MEDIAN_TRIPLE = "tax_median IS NOT NULL AND quantity_median BETWEEN 2 AND 45 AND discount_median BETWEEN 0.02 AND 0.09"


@query(
    "candidate_population_orders",
    f"""WITH {MEASUREMENTS}, a AS ({_candidate_sql(where=SQL_TRIPLE)}), b AS ({_candidate_sql()})
SELECT 'filter_then_median' AS population_order, count(*) AS n_candidates, sum(n_rows)::BIGINT AS n_rows FROM a
UNION ALL SELECT 'median_then_filter', count(*), sum(n_rows)::BIGINT FROM b WHERE {_MEDIAN_TRIPLE}""",
)
def candidate_population_orders(spark, sf_dir):
    bound = row_bound(spark, sf_dir, "lineitem")
    rows = measurements(spark, sf_dir)
    parts = [
        cand.candidate_population(rows, MEASURED, TRIPLE, order, key=CANDIDATE_KEY, rows_bound=bound).agg(
            F.count("*").alias("n_candidates"), F.sum("n_rows").alias("n_rows")
        ).select(F.lit(order).alias("population_order"), "n_candidates", "n_rows")
        for order in ("filter_then_median", "median_then_filter")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "feasible_set",
    f"""WITH {MEASUREMENTS}, c AS ({_candidate_sql(where=SQL_TRIPLE)}), q AS (SELECT quantile_cont(quantity_median, 0.25) AS cut FROM c)
SELECT round(cut, 6) AS quantile_cut, n_feasible, n_population, round(100.0::DOUBLE * n_feasible / n_population, 2) AS pct FROM (
  SELECT max(cut) AS cut, count(*) FILTER (WHERE quantity_median <= cut AND price_median >= 10000) AS n_feasible, count(*) AS n_population FROM c, q)""",
)
def feasible_set(spark, sf_dir):
    bound = row_bound(spark, sf_dir, "lineitem")
    population = cand.candidate_population(measurements(spark, sf_dir), MEASURED, TRIPLE, "filter_then_median", key=CANDIDATE_KEY, rows_bound=bound)
    return rounded(profile.feasible_set(population, "quantity_median", "price_median", 10000.0, rows_bound=bound))


@query(
    "feasible_rows",
    f"WITH {MEASUREMENTS} SELECT count(*) AS n_rows FROM measurements WHERE {SQL_TRIPLE} AND quantity <= 12 AND price >= 10000",
)
def feasible_rows(spark, sf_dir):
    mask = filters.core_triple(MEASURED, TRIPLE)
    return profile.feasible_rows(measurements(spark, sf_dir), mask, "quantity", 12.0, "price", 10000.0)


@query(
    "distinct_battery",
    "SELECT quantity, n, n = 100 AS matches_claim FROM (SELECT 'rows' AS quantity, count(*) AS n FROM lineitem "
    + "".join(f"UNION ALL SELECT 'distinct {c}', count(DISTINCT {c}) FROM lineitem " for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    + ")",
)
def distinct_battery(spark, sf_dir):
    return profile.distinct_battery(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_monomer"], 100)


_CAPTURE_SQL = f"""WITH {MEASUREMENTS}, c AS ({_candidate_sql()}),
inside AS (SELECT candidate_id, bool_or(flag) AS passes FROM measurements WHERE {SQL_TRIPLE} GROUP BY 1),
people AS (SELECT 'triple' AS population, candidate_id FROM inside UNION ALL SELECT 'flagged', candidate_id FROM inside WHERE passes),
valued AS (SELECT population, tax_median AS objective, quantity_median AS quantity, discount_median AS discount FROM people LEFT JOIN c USING (candidate_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY population ORDER BY objective NULLS LAST, quantity NULLS LAST, discount NULLS LAST) - 1 AS p FROM valued)
SELECT population, round(objective, 6) AS objective, round(quantity, 6) AS quantity, round(discount, 6) AS discount, count(*) AS n, min(p) AS pos
FROM placed GROUP BY population, placed.objective, placed.quantity, placed.discount"""


def _capture(spark: SparkSession, sf_dir: str, bound: int | None) -> DataFrame:
    rows = measurements(spark, sf_dir)
    table = cand.build_candidates(rows, PROPERTIES, key=CANDIDATE_KEY, rows_bound=bound)
    captured = populations.capture(
        rows, table, MEASURED, TRIPLE, "flag", ["quantity", "discount"], key=CANDIDATE_KEY, rows_bound=bound
    )
    return rounded(captured)


@query("population_capture", _CAPTURE_SQL)
def population_capture(spark, sf_dir):
    return _capture(spark, sf_dir, row_bound(spark, sf_dir, "lineitem"))


def _report_sql() -> str:
    def part(prefix: str, oracle: str, name: str, value: str) -> str:
        return f"SELECT '{prefix}' || {name} AS finding_id, {value}::DOUBLE AS number FROM ({SHELF.oracles[oracle]})"

    return " UNION ALL ".join(
        [
            part("coverage_", "coverage", "property", "n_rows"), part("outside_", "range_audit", "property", "outside"),
            part("ladder_", "filter_ladder", "step", "n_rows"), part("rung_", "rung_ladder", "rung", "n_rows"),
            part("label_", "label_frequency", "label", "n_rows"), part("resolved_", "label_audit", "outcome", "n"),
            part("noise_", "noise_floor", "property", "median_rel_std"), part("spearman_", "rank_correlation", "left_column || '_' || right_column", "spearman"),
            "SELECT 'replicated' AS finding_id, n_multi_row::DOUBLE FROM (" + SHELF.oracles["replicate_structure"] + ")",
            "SELECT 'window' AS finding_id, n_rows::DOUBLE FROM (" + SHELF.oracles["quantile_window"] + ")",
            "SELECT 'feasible' AS finding_id, n_feasible::DOUBLE FROM (" + SHELF.oracles["feasible_set"] + ")",
        ]
    )


@query("validation_report", _report_sql())
def validation_report(spark, sf_dir):
    """All sections of the profile as one set of observations."""
    pairs = rank_correlation(spark, sf_dir).withColumn("pair", F.concat_ws("_", "left_column", "right_column"))
    # Written once, because two sections read it and each reads it several times.
    bound = row_bound(spark, sf_dir, "lineitem")
    needed = ["n_rows", *[f"{name}_{what}" for name in PROPERTIES for what in ("n", "std", "median")]]
    held = write_shared(_candidates(spark, sf_dir, bound).select(*needed), "report-candidates")
    noise = rounded(cand.noise_floor(held, PROPERTIES, rows_bound=bound))
    parts = [
        findings.observed_rows(coverage(spark, sf_dir), "coverage_", "property", "n_rows"),
        findings.observed_rows(range_audit(spark, sf_dir), "outside_", "property", "outside"),
        findings.observed_rows(filter_ladder(spark, sf_dir), "ladder_", "step", "n_rows"),
        findings.observed_rows(rung_ladder(spark, sf_dir), "rung_", "rung", "n_rows"),
        findings.observed_rows(label_frequency(spark, sf_dir), "label_", "label", "n_rows"),
        findings.observed_rows(label_audit(spark, sf_dir), "resolved_", "outcome", "n"),
        findings.observed_rows(noise, "noise_", "property", "median_rel_std"),
        findings.observed_rows(pairs, "spearman_", "pair", "spearman"),
        findings.observed_numbers(cand.replicate_structure(held), {"replicated": "n_multi_row"}),
        findings.observed_numbers(quantile_window(spark, sf_dir), {"window": "n_rows"}),
        findings.observed_numbers(feasible_set(spark, sf_dir), {"feasible": "n_feasible"}),
    ]
    return findings.observations(*parts).select("finding_id", "number")
