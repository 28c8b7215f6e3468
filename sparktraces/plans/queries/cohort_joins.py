"""Cohort filters, key sets and joins over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktraces.functions.labels import parse_folder
from sparktraces.operators import cohorts
from sparktraces.operators.sequence import number_rows, renumber
from sparktraces.operators.stage import staging_path
from sparktraces.plans.bindings import KEYS, TRACES, traces
from sparktraces.plans.queries.ordered import HOLES
from sparktraces.plans.registry import query, rounded, sql_round, table
from sparktraces.sources import folder_source as folder_reader
from sparktraces.sources import sinks
from sparktraces.sources import tables as S


@query(
    "keyword_cohort",
    "F1 F5",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL",
)
def keyword_cohort(spark, sf_dir):
    rows = cohorts.keyword_filter(
        table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"]
    )
    return rows.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "shared_controls",
    "F6 F7",
    """
WITH p AS (SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 9000 AND c_nationkey < 5)
SELECT c_custkey, c_mktsegment FROM customer
WHERE (c_acctbal > 9000 AND c_nationkey < 5) OR c_mktsegment IN (SELECT c_mktsegment FROM p) OR NOT EXISTS (SELECT 1 FROM p)
""",
)
def shared_controls(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn(
        "condition", F.when((F.col("c_acctbal") > 9000) & (F.col("c_nationkey") < 5), "EP").otherwise("ASP")
    )
    return cohorts.shared_controls(rows, treatment="c_mktsegment", condition="condition").select("c_custkey", "c_mktsegment")


@query(
    "semi_anti_cohorts",
    "J3 J4",
    """
SELECT o_orderkey, 'kept' AS side FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
UNION ALL SELECT o_orderkey, 'left' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
""",
)
def semi_anti_cohorts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customer = table(spark, sf_dir, "customer")
    kept = cohorts.restrict_to(orders, customer.filter(F.col("c_acctbal") > 5000), ["c_custkey"])
    left = cohorts.exclude(orders, customer.filter(F.col("c_acctbal") < 0), ["c_custkey"])
    return kept.select("o_orderkey", F.lit("kept").alias("side")).unionByName(
        left.select("o_orderkey", F.lit("left").alias("side"))
    )


@query(
    "row_index_join",
    "J1 J5",
    """
WITH a AS (SELECT l_orderkey, l_linenumber AS frame, l_quantity AS len FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber AS frame, l_tax AS dye FROM lineitem WHERE l_discount > 0.02),
c AS (SELECT l_orderkey, l_linenumber AS frame, l_discount AS actin FROM lineitem WHERE l_returnflag = 'A')
SELECT a.l_orderkey, count(*) AS n, count(b.dye) AS n_dye, count(c.actin) AS n_actin
FROM a LEFT JOIN b USING (l_orderkey, frame) LEFT JOIN c USING (l_orderkey, frame) GROUP BY a.l_orderkey
""",
)
def row_index_join(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "frame")
    base = rows.select("l_orderkey", "frame", F.col("l_quantity").alias("len"))
    dye = rows.filter(F.col("l_discount") > 0.02).select("l_orderkey", "frame", F.col("l_tax").alias("dye"))
    actin = rows.filter(F.col("l_returnflag") == "A").select("l_orderkey", "frame", F.col("l_discount").alias("mean"))
    out = S.rebuild(base, ["l_orderkey", "frame"], uptake=dye, actin=actin)
    return out.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count("uptake_dye").alias("n_dye"), F.count("actin_mean").alias("n_actin")
    )


@query(
    "row_index_cut",
    "J1",
    """
WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS frame, l_quantity AS len FROM lineitem),
b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS frame, l_tax AS dye FROM lineitem WHERE l_discount > 0.02 OR l_returnflag = 'A'),
n AS (SELECT coalesce(x.l_orderkey, y.l_orderkey) AS l_orderkey, coalesce(x.c, 0) - coalesce(y.c, 0) AS over FROM (SELECT l_orderkey, count(*) AS c FROM a WHERE l_orderkey % 5 <> 0 GROUP BY 1) x
  FULL JOIN (SELECT l_orderkey, count(*) AS c FROM b GROUP BY 1) y ON x.l_orderkey = y.l_orderkey),
j AS (SELECT a.l_orderkey, count(*) AS n, sum(len) AS len, count(dye) AS n_dye FROM a JOIN b USING (l_orderkey, frame) WHERE a.l_orderkey % 5 <> 0 GROUP BY 1)
SELECT n.l_orderkey, coalesce(j.n, 0) AS n, len, coalesce(n_dye, 0) AS n_dye, greatest(over, 0) AS left_surplus, greatest(-over, 0) AS right_surplus FROM n LEFT JOIN j ON j.l_orderkey = n.l_orderkey
""",
)
def row_index_cut(spark, sf_dir):
    """Detection and uptake on the same row, cut to the shorter, with the rows that either side has beyond the other."""
    rows = table(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    detection = number_rows(rows.filter(F.col("l_orderkey") % 5 != 0), ["l_orderkey"], order, "l_linenumber").select("l_orderkey", "frame", F.col("l_quantity").alias("len"))
    uptake = number_rows(rows.filter((F.col("l_discount") > 0.02) | (F.col("l_returnflag") == "A")), ["l_orderkey"], order, "l_linenumber")
    cut, report = S.cut_to_shorter(detection, uptake.select("l_orderkey", "frame", F.col("l_tax").alias("dye")), ["l_orderkey"])
    counts = cut.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"), F.count("dye").alias("n_dye"))
    out = report.join(counts, "l_orderkey", "left")
    return out.select("l_orderkey", F.coalesce("n", F.lit(0)).alias("n"), "len", F.coalesce("n_dye", F.lit(0)).alias("n_dye"), "left_surplus", "right_surplus")


@query(
    "bundle_commit",
    "K3 K6 K8 K9",
    """
WITH f AS (SELECT l_orderkey, l_linenumber, l_discount > 0.05 AS bad FROM lineitem)
SELECT 'excluded' AS name, count(*) AS n FROM f WHERE bad UNION ALL SELECT 'kept', count(*) FROM f WHERE NOT bad UNION ALL SELECT 'all', count(*) FROM f
UNION ALL SELECT 'fates', count(DISTINCT l_returnflag) FROM lineitem
""",
)
def bundle_commit(spark, sf_dir):
    """The feature table three ways and a count table, committed twice; readers see the second commit, whole."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount")
    fates = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    root = staging_path(spark, "bundle")
    sinks.commit_bundle(spark, sinks.analysis_tables(fates=fates.limit(1)), root)
    tables = sinks.analysis_tables(**sinks.split_by_check(rows, F.col("l_discount") > 0.05), fates=fates, nothing=fates.limit(0))
    sinks.commit_bundle(spark, tables, root, partitions={"kept": ["l_returnflag"]})
    counts = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name, df in sinks.read_committed(spark, root).items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out.select("name", "n")


@query(
    "first_match_lookup",
    "J2 J6 U2",
    """
WITH f AS (SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1)
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN f ON o_custkey = c_custkey
""",
)
def first_match_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return cohorts.lookup(customers, orders, ["c_custkey"], F.col("o_orderkey"))


@query(
    "replicated_controls",
    "J7",
    TRACES
    + """SELECT duration, count(*) AS n, count(DISTINCT trace_id) AS traces FROM (
  SELECT trace_id, arm AS duration FROM tr WHERE condition = 'EP'
  UNION ALL SELECT trace_id, d FROM tr, (VALUES ('100us'), ('5ms')) v(d) WHERE condition = 'ASP') GROUP BY duration
""",
)
def replicated_controls(spark, sf_dir):
    rows = traces(spark, sf_dir)
    pulsed = rows.filter(F.col("condition") == "EP").select("trace_id", F.col("arm").alias("duration"))
    controls = cohorts.replicate(rows.filter(F.col("condition") == "ASP").select("trace_id"), ["100us", "5ms"], "duration")
    return pulsed.unionByName(controls).groupBy("duration").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("trace_id").alias("traces")
    )


@query(
    "key_sets",
    "J15 U4 U8",
    """
WITH a AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_discount = 0.1 AND l_quantity > 45), b AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_tax = 0.08 AND l_quantity < 5)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_second,
  (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common
""",
)
def key_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    a = rows.filter((F.col("l_discount") == 0.1) & (F.col("l_quantity") > 45)).select("l_suppkey")
    b = rows.filter((F.col("l_tax") == 0.08) & (F.col("l_quantity") < 5)).select("l_suppkey")
    return cohorts.set_difference_counts(a, b)


@query(
    "union_ragged",
    "U1 U7",
    """
SELECT key, kind, count(*) AS n, count(priority) AS n_priority, count(segment) AS n_segment FROM (
  SELECT o_custkey AS key, 'order' AS kind, o_orderpriority AS priority, NULL AS segment FROM orders
  UNION ALL SELECT c_custkey, 'customer', NULL, c_mktsegment FROM customer) GROUP BY key, kind
""",
)
def union_ragged(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.lit("order").alias("kind"), F.col("o_orderpriority").alias("priority")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment")
    )
    both = orders.unionByName(customers, allowMissingColumns=True)
    return both.groupBy("key", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("priority").alias("n_priority"), F.count("segment").alias("n_segment")
    )


@query(
    "renumbered_rows",
    "U3 O6 F3",
    HOLES + "SELECT event_id, frame, n FROM ok WHERE n >= 15 AND (frame < 3 OR frame >= n - 3)",
)
def renumbered_rows(spark, sf_dir):
    rows = traces(spark, sf_dir).drop("n_rows").filter(F.col("event_id") % 17 != 0)
    dense = renumber(rows, KEYS, n_rows="n").filter(F.col("n") >= 15)
    ends = cohorts.first_rows(dense, 3).unionByName(cohorts.last_rows(dense, KEYS, 3, n_rows="n"))
    return ends.select("event_id", "frame", "n").distinct()


@query(
    "trace_folders",
    "S1 S2",
    f"""
SELECT '2401' || lpad(CAST(user_id % 7 + 1 AS VARCHAR), 2, '0') AS date, CASE WHEN user_id % 3 = 0 THEN 'ASP' ELSE 'EP' END AS condition_type,
  count(*) AS n, count(CASE WHEN event_id % 17 <> 0 THEN 1 END) AS n_y, {sql_round('max(value) FILTER (WHERE event_id % 17 <> 0)')} AS top
FROM events GROUP BY ALL
""",
)
def trace_folders(spark, sf_dir):
    """events written as folders of trace files that follow the naming grammar, then found and read back."""
    k = F.col("user_id")
    day = F.lpad((k % 7 + 1).cast("string"), 2, "0")
    folder = F.concat(
        F.lit("2401"), day, F.lit("_MDAMB231_WT_Chip1_Experiment3-1100Pa-"), F.when(k % 3 == 0, "0").otherwise("100"), F.lit("V-5ms-frame10")
    )
    rows = table(spark, sf_dir, "events").select(
        folder.alias("experiment"), k.alias("Trap"), F.col("event_id").alias("Frame"),
        F.when(F.col("event_id") % 17 != 0, F.col("value").cast("string")).otherwise("nan").alias("Length"),
    )
    root = staging_path(spark, "folders")
    sinks.write_folders(rows, root)
    back = S.read_traces(spark, root).withColumn("_f", parse_folder(F.col("experiment"))).filter(F.col("_f").isNotNull())
    return back.groupBy("_f.date", "_f.condition_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("Length").alias("n_y"), rounded(F.max("Length")).alias("top")
    )


@query(
    "folder_source",
    "S1 S3 S8 S16",
    f"""
WITH e AS (SELECT *, '2401' || lpad(CAST(user_id % 7 + 1 AS VARCHAR), 2, '0') AS date FROM events)
SELECT date, 'rows' AS kind, count(DISTINCT user_id) AS traps, count(*) AS n, count(*) FILTER (WHERE event_id % 17 <> 0) AS n_y,
  {sql_round('sum(value) FILTER (WHERE event_id % 17 <> 0)', 3)} AS total FROM e WHERE user_id % 11 <> 0 GROUP BY date
UNION ALL SELECT date, 'missing columns', count(DISTINCT user_id), NULL, NULL, NULL FROM e WHERE user_id % 11 = 0 GROUP BY date
""",
)
def folder_source(spark, sf_dir):
    """events as a folder for each experiment and trap, some without the wanted column, read through the data source."""
    k = F.col("user_id")
    day = F.lpad((k % 7 + 1).cast("string"), 2, "0")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("2401"), day, F.lit("_MDAMB231_WT_Chip1_Experiment3-1100Pa-0V-5ms-frame10")).alias("experiment"),
        F.concat(F.lit("Trap_"), k.cast("string"), F.lit("_detection")).alias("file"), k.alias("user"),
        F.col("event_id").alias("Frame"), F.when(F.col("event_id") % 17 != 0, F.col("value").cast("string")).alias("Length"),
    )
    root = staging_path(spark, "folders")
    for part, length in ((rows.filter(F.col("user") % 11 != 0), "Length (um)"), (rows.filter(F.col("user") % 11 == 0), "Width")):
        folder_reader.write_files(part.drop("user").withColumnRenamed("Length", length), root, ["experiment", "file"])
    folder_reader.register(spark)
    source = spark.read.format("trace_folders").option("path", root).option("slices", spark.sparkContext.defaultParallelism).option("columns", "frame=frame_index|Frame,length=Length|Length (um)")
    date = F.substring("experiment", 1, 6).alias("date")
    length = F.col("length").try_cast("double")
    left = source.option("report", "true").load()
    left = left.groupBy(date).agg(F.max("reason").alias("kind"), F.count_distinct(F.regexp_extract("path", r"Trap_(\d+)", 1)).alias("traps"))
    read = source.option("report", "false").load().groupBy(date).agg(
        F.lit("rows").alias("kind"), F.count_distinct("trap_id").alias("traps"), F.count("frame").alias("n"), F.count(length).alias("n_y"),
        rounded(F.sum(length), 3).alias("total"),
    )
    none = {"n": F.lit(None).cast("long"), "n_y": F.lit(None).cast("long"), "total": F.lit(None).cast("double")}
    return read.unionByName(left.withColumns(none))
