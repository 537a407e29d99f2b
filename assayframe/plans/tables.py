"""The given tables seen as measurements, lookups, selections and logs.

Each view exists twice: as a DataFrame for the operators and as a SQL common
table expression for the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.columns import normalise_label
from assayframe.operators.scale import running, running_by_size
from assayframe.session import tune
from assayframe.sources.measurements import nans_to_null
from assayframe.sources.registry import Property, Registry

MEASURED = Registry(
    [
        Property("tax", "tax", "share", "objective", 0.0, 0.07, keep_flag=True),
        Property("quantity", "quantity", "pieces", "constraint", 2.0, 45.0),
        Property("discount", "discount", "share", "constraint", 0.02, 0.09, ladder=(0.02, 0.04, 0.06, 0.08)),
        Property("price", "price", "usd", "intermediate", 1000.0, 90000.0),
    ]
)
# The natural key of a candidate of these rows.
CANDIDATE_KEY = ["l_partkey", "tidy_label"]
TRIPLE = ("tax", "quantity", "discount")
SERVED = Registry(
    [
        Property("retail", "retail", "usd", "objective", 0.0, 5000.0),
        Property("size", "size", "cm", "constraint", 0.0, 60.0),
    ]
)
POPULATIONS = ("all", "promo")
MAX_SIZE = 25.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table with its missing numbers missing: NaN is NULL from the scan on."""
    return nans_to_null(tune(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def row_bound(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Rows of the named tables together, from the Parquet footers."""
    return sum(spark.read.parquet(f"{sf_dir}/{name}.parquet").count() for name in names)


# -- measurements ----------------------------------------------------------------------------

MEASUREMENTS = """measurements AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus,
         nullif(l_returnflag, 'N') AS label, l_linestatus = 'F' AS flag,
         l_quantity AS quantity, l_extendedprice AS price,
         nullif(l_discount, 0.0) AS discount, nullif(l_tax, 0.0) AS tax,
         substr(sha256(l_partkey::VARCHAR || '|' || coalesce(nullif(l_returnflag, 'N'), 'unknown')), 1, 16) AS candidate_id
  FROM lineitem)"""

SQL_TRIPLE = "(tax IS NOT NULL AND coalesce(quantity BETWEEN 2 AND 45, false) AND coalesce(discount BETWEEN 0.02 AND 0.09, false))"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as measurement rows; a zero discount or tax counts as not measured."""
    lines = table(spark, sf_dir, "lineitem")
    label = F.nullif("l_returnflag", F.lit("N"))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus",
        label.alias("label"), (F.col("l_linestatus") == "F").alias("flag"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        normalise_label(label).alias("tidy_label"),
    )


# -- lookups ---------------------------------------------------------------------------------

CANDIDATES = """candidates AS (
  SELECT p_partkey AS candidate_id, p_type, p_name,
         p_retailprice AS retail_median, 2::BIGINT AS retail_n, p_retailprice / 100 AS retail_std,
         CASE WHEN p_size >= 5 THEN p_size::DOUBLE END AS size_median,
         CASE WHEN p_size > 25 THEN 1 ELSE 3 END::BIGINT AS size_n, p_size / 10.0::DOUBLE AS size_std
  FROM part WHERE p_brand <> 'Brand#13')"""

LOOKUPS = """entries AS (
  SELECT o_custkey AS run_id, o_orderkey AS request_seq, l_partkey AS candidate_id, l_linestatus,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS entry_pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
lookups AS (
  SELECT run_id, request_seq, entry_pos, candidate_id, p.prop_pos, p.property
  FROM entries, LATERAL (
    SELECT unnest(CASE WHEN l_linestatus = 'F' THEN ['size', 'weight', 'retail'] ELSE ['retail', 'size'] END) AS property,
           unnest(CASE WHEN l_linestatus = 'F' THEN [0, 1, 2] ELSE [0, 1] END) AS prop_pos) p)"""

ANSWERS = f"""{CANDIDATES}, {LOOKUPS},
answers AS (
  SELECT k.*,
    CASE WHEN property NOT IN ('retail', 'size') THEN 'unsupported'
         WHEN c.candidate_id IS NULL THEN 'missing'
         WHEN CASE property WHEN 'retail' THEN retail_median ELSE size_median END IS NULL THEN 'missing'
         ELSE 'ok' END AS status,
    CASE WHEN property NOT IN ('retail', 'size') THEN NULL
         WHEN c.candidate_id IS NULL THEN 'candidate_unknown'
         WHEN CASE property WHEN 'retail' THEN retail_median ELSE size_median END IS NULL THEN 'value_absent' END AS reason,
    CASE property WHEN 'retail' THEN retail_median WHEN 'size' THEN size_median END AS value,
    CASE property WHEN 'retail' THEN retail_n WHEN 'size' THEN size_n END AS n,
    CASE property WHEN 'retail' THEN retail_std WHEN 'size' THEN size_std END AS std
  FROM lookups k LEFT JOIN candidates c USING (candidate_id))"""

RESULTS = f"""{ANSWERS},
flagged AS (
  SELECT *, coalesce(min(CASE WHEN status IN ('ok', 'missing') THEN request_seq END)
      OVER (PARTITION BY run_id, candidate_id, property) < request_seq, false) AS cached
  FROM answers),
charged AS (
  SELECT *, CASE WHEN status = 'ok' AND NOT cached AND row_number() OVER (
        PARTITION BY run_id, request_seq, candidate_id, status = 'ok' AND NOT cached
        ORDER BY entry_pos, prop_pos) = 1 THEN 1 ELSE 0 END AS evals
  FROM flagged)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a candidate table.  One brand is not in it, small parts have no size."""
    parts = table(spark, sf_dir, "part").where(F.col("p_brand") != "Brand#13")
    size = F.col("p_size")
    return parts.select(
        F.col("p_partkey").alias("candidate_id"), "p_type", "p_name",
        F.col("p_retailprice").alias("retail_median"), F.lit(2).cast("long").alias("retail_n"),
        (F.col("p_retailprice") / 100).alias("retail_std"),
        F.when(size >= 5, size.cast("double")).alias("size_median"),
        F.when(size > 25, 1).otherwise(3).cast("long").alias("size_n"),
        (size / F.lit(10.0)).alias("size_std"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the order they belong to."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate"
    )
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def lookups(spark: SparkSession, sf_dir: str, rows_bound: int | None, *, by_candidate: bool = False) -> DataFrame:
    """Orders as requests: a customer is a run, a line an entry, two or three properties per entry.

    ``by_candidate`` brings the lines of a candidate together before they unfold
    into lookups, which spares what follows a shuffle of all lookups.
    """
    chunk = F.struct("l_linenumber", F.floor(F.col("l_partkey") / 1_000_000))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    # An order is one row, so it has no more rows in the join than lines.
    placed = running_by_size(
        order_lines(spark, sf_dir), ["l_orderkey"], order, {"place": ("sum", F.lit(1))}, chunk=chunk, rows_bound=rows_bound,
        sized=table(spark, sf_dir, "lineitem").select("l_orderkey"),
    )
    if by_candidate:
        placed = placed.select("o_custkey", "o_orderkey", "place", "l_partkey", "l_linestatus").repartition("l_partkey")
    long_list = F.array(F.lit("size"), F.lit("weight"), F.lit("retail"))
    properties = F.when(F.col("l_linestatus") == "F", long_list).otherwise(F.array(F.lit("retail"), F.lit("size")))
    return placed.select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("request_seq"),
        (F.col("place") - 1).alias("entry_pos"), F.col("l_partkey").alias("candidate_id"),
        F.posexplode(properties).alias("prop_pos", "property"),
    )


# -- selections ------------------------------------------------------------------------------

PICKS = f"""{CANDIDATES},
reported AS (
  SELECT o_custkey AS run_id, year(o_orderdate) - 1994 AS iteration, o_orderpriority AS beam, min(o_orderkey) AS seq
  FROM orders GROUP BY ALL),
chosen AS (
  SELECT DISTINCT o_custkey AS run_id, year(o_orderdate) - 1994 AS iteration, o_orderpriority AS beam, l_partkey AS candidate_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
picks AS (
  SELECT ch.*, retail_median AS objective, coalesce(size_median <= 25, false) AS feasible
  FROM chosen ch LEFT JOIN candidates USING (candidate_id)),
members AS (
  SELECT 'all' AS population, candidate_id, retail_median AS objective, size_median AS size, coalesce(size_median <= 25, false) AS feasible
  FROM candidates
  UNION ALL
  SELECT 'promo', candidate_id, retail_median, size_median, coalesce(size_median <= 25, false)
  FROM candidates WHERE p_type = 'PROMO')"""


def iteration_of() -> F.Column:
    return (F.year("o_orderdate") - F.lit(1994)).cast("long")


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per run, iteration and beam; an order without lines reports an empty beam."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_custkey").alias("run_id"), iteration_of().alias("iteration"), F.col("o_orderpriority").alias("beam")
    ).agg(F.min("o_orderkey").alias("seq"))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).select(
        F.col("o_custkey").alias("run_id"), iteration_of().alias("iteration"), F.col("o_orderpriority").alias("beam"),
        F.col("l_partkey").alias("candidate_id"),
    ).distinct()


def _feasible() -> F.Column:
    return F.coalesce(F.col("size_median") <= MAX_SIZE, F.lit(False))


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = chosen(spark, sf_dir).join(candidates(spark, sf_dir), "candidate_id", "left")
    return joined.select("run_id", "iteration", "beam", "candidate_id", F.col("retail_median").alias("objective"), _feasible().alias("feasible"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two populations side by side, values as the evaluator serves them."""
    parts = candidates(spark, sf_dir)
    names = F.when(F.col("p_type") == "PROMO", F.array(F.lit("all"), F.lit("promo"))).otherwise(F.array(F.lit("all")))
    return parts.select(
        F.explode(names).alias("population"), "candidate_id", F.col("retail_median").alias("objective"),
        F.col("size_median").alias("size"), _feasible().alias("feasible"),
    )


def population_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in POPULATIONS], "population string")


# -- logs ------------------------------------------------------------------------------------

KINDS = {
    "signup": "iteration_opened", "purchase": "iteration_closed", "view": "selection", "click": "evaluation", "error": "run_closed",
}

LOG = """raw_log AS (
  SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'iteration_opened' WHEN 'purchase' THEN 'iteration_closed'
           WHEN 'view' THEN 'selection' WHEN 'click' THEN 'evaluation' ELSE 'run_closed' END AS event, props
  FROM events),
log AS (
  SELECT *, 1 + count(*) FILTER (WHERE event = 'iteration_closed')
      OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS iteration
  FROM raw_log)"""


def event_log(spark: SparkSession, sf_dir: str, chunk) -> DataFrame:
    """User events as a run log; an iteration number counts the closings before it."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("event"), "props"
    )
    closed = (F.col("event") == "iteration_closed").cast("long")
    numbered = running(raw, ["run_id"], ["seq"], {"closed": ("sum", closed)}, chunk=chunk, inclusive=False)
    return numbered.withColumn("iteration", F.coalesce("closed", F.lit(0)) + 1).drop("closed")
