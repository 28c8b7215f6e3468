"""Pixel-table operators over the embeddings read as small images, and file manifests over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktraces.operators import pixels
from sparktraces.plans.queries.labels import FILES, file_names
from sparktraces.plans.registry import query, rounded, sql_round, table
from sparktraces.sources import manifest as M
from sparktraces.sources import sinks

# Every vector is an 8 x 8 image; the left three columns are the protrusion, the rest the body.
PIXELS = """
WITH px AS (
  SELECT vec_id, label, (u - 1) // 8 AS yy, (u - 1) % 8 AS xx, CAST(embedding[u] AS DOUBLE) * 100 + 50 AS v,
    CASE WHEN (u - 1) % 8 < 3 THEN 'prot' ELSE 'body' END AS region
  FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS u FROM embeddings))
"""


def pixel_rows(spark, sf_dir):
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", "label", F.posexplode("embedding").alias("u", "e"))
        .select(
            "vec_id",
            "label",
            F.floor(F.col("u") / 8).alias("yy"),
            (F.col("u") % 8).cast("long").alias("xx"),
            (F.col("e").cast("double") * 100 + 50).alias("v"),
            F.when(F.col("u") % 8 < 3, "prot").otherwise("body").alias("region"),
        )
    )


@query(
    "kymograph_long",
    "K5 X4",
    f"""SELECT vec_id, CAST(u - 1 AS BIGINT) AS position, {sql_round('(u - 1) * 0.629::DOUBLE')} AS position_um, CASE WHEN u <= 64 THEN {sql_round('CAST(embedding[u] AS DOUBLE)', 5)} END AS intensity
FROM (SELECT vec_id, embedding, unnest(range(1, 71)) AS u FROM embeddings)""",
)
def kymograph_long(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("profile"))
    out = sinks.kymograph_long(rows, ["vec_id"], "profile", scale=0.629, width=70)
    return out.select("vec_id", F.col("position").cast("long").alias("position"), rounded("position_um").alias("position_um"), rounded("intensity", 5).alias("intensity"))


@query(
    "contrast_stretch",
    "X1",
    PIXELS
    + """, e AS (SELECT vec_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.999) AS hi FROM px GROUP BY vec_id),
s AS (SELECT px.vec_id, CAST(floor((least(greatest(v, lo), hi) - lo) / (hi - lo) * 255) AS BIGINT) AS level FROM px JOIN e ON e.vec_id = px.vec_id)
SELECT vec_id, CAST(min(level) AS BIGINT) AS low, CAST(max(level) AS BIGINT) AS high, CAST(sum(level) // 16 AS BIGINT) AS total, count(*) AS n FROM s GROUP BY vec_id""",
)
def contrast_stretch(spark, sf_dir):
    out = pixels.contrast_stretch(pixel_rows(spark, sf_dir), ["vec_id"], "v")
    level = F.col("level").cast("long")
    return out.groupBy("vec_id").agg(
        F.min(level).alias("low"), F.max(level).alias("high"), F.floor(F.sum(level) / 16).alias("total"), F.count(F.lit(1)).alias("n")
    )


@query(
    "region_pixel_stats",
    "X2",
    PIXELS
    + f"""SELECT vec_id, region, {sql_round('avg(v)')} AS mean, {sql_round('stddev_pop(v)')} AS sd, {sql_round('CASE WHEN avg(v) > 0 THEN stddev_pop(v) / avg(v) ELSE 0 END')} AS cv, count(*) AS pixels FROM px GROUP BY vec_id, region""",
)
def region_pixel_stats(spark, sf_dir):
    out = pixels.region_stats(pixel_rows(spark, sf_dir), ["vec_id", "region"], "v")
    return out.select("vec_id", "region", *[rounded(c).alias(c) for c in ("mean", "sd", "cv")], "pixels")


@query(
    "zones",
    "X3",
    PIXELS
    + f""", b AS (SELECT *, min(xx) OVER (PARTITION BY vec_id, region) AS lo, max(xx) OVER (PARTITION BY vec_id, region) AS hi FROM px WHERE v > 50),
z AS (SELECT *, CASE WHEN hi > lo THEN CASE region WHEN 'prot' THEN CASE WHEN xx <= (lo + hi) // 2 THEN 'tip' ELSE 'base' END
  ELSE CASE WHEN xx <= lo + greatest(1, (hi - lo) // 3) THEN 'near' ELSE 'far' END END END AS zone FROM b)
SELECT vec_id, zone, count(*) AS n, {sql_round('avg(v)')} AS mean FROM z WHERE zone IS NOT NULL GROUP BY vec_id, zone""",
)
def zones(spark, sf_dir):
    out = pixels.zones(pixel_rows(spark, sf_dir).filter(F.col("v") > 50), ["vec_id"], "region", "xx")
    return (
        out.filter(F.col("zone").isNotNull())
        .groupBy("vec_id", "zone")
        .agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("v")).alias("mean"))
    )


@query(
    "strip_kymograph",
    "X4 X5",
    PIXELS
    + f"SELECT vec_id, xx, {sql_round('avg(v)')} AS profile, {sql_round('(xx - 3) * 0.5')} AS position_um FROM px WHERE yy BETWEEN 3 AND 5 GROUP BY vec_id, xx",
)
def strip_kymograph(spark, sf_dir):
    out = pixels.strip_kymograph(
        pixel_rows(spark, sf_dir), ["vec_id"], "yy", "xx", "v", height=8, rows=3, scale=0.5, x0=3
    )
    return out.select("vec_id", "xx", rounded("profile").alias("profile"), rounded("position_um").alias("position_um"))


@query(
    "ahead_of_tip",
    "X6 X10",
    PIXELS
    + f""", l AS (SELECT vec_id, min(xx) FILTER (WHERE v > 60 AND region = 'body') AS far, count(*) FILTER (WHERE v > 60 AND region = 'body') AS area FROM px GROUP BY vec_id)
SELECT l.vec_id, {sql_round('coalesce(8 - max(far), 0)')} AS length, max(area) AS area,
  {sql_round('coalesce(avg(v) FILTER (WHERE xx >= coalesce(far, 8) - 1 - 2 AND xx < coalesce(far, 8) - 1 AND yy BETWEEN 1 AND 6), 0)')} AS ahead
FROM l JOIN px ON px.vec_id = l.vec_id GROUP BY l.vec_id""",
)
def ahead_of_tip(spark, sf_dir):
    rows = pixel_rows(spark, sf_dir)
    length = pixels.tracked_length(rows, ["vec_id"], "xx", (F.col("v") > 60) & (F.col("region") == "body"), x0=8.0)
    tips = length.select("vec_id", (F.lit(8.0) - F.col("length")).alias("tip_x"))
    ahead = pixels.ahead_of_tip(rows, tips, ["vec_id"], "yy", "xx", "v", offset=1, width=2, y_lo=1, y_hi=6)
    out = length.join(ahead, "vec_id")
    return out.select("vec_id", rounded("length").alias("length"), "area", rounded("ahead").alias("ahead"))


@query(
    "subpixel_edge",
    "X7",
    PIXELS
    + f""", p AS (SELECT vec_id, xx, avg(v) AS v FROM px GROUP BY vec_id, xx),
n AS (SELECT *, lead(v) OVER (PARTITION BY vec_id ORDER BY xx) AS nx, min(v) OVER (PARTITION BY vec_id) AS fl FROM p),
t AS (SELECT vec_id, quantile_cont(v, 0.5) AS lv FROM p WHERE xx > 2 GROUP BY vec_id),
h AS (SELECT n.*, lv, fl + 0.5 * (lv - fl) AS level, row_number() OVER (PARTITION BY n.vec_id ORDER BY xx DESC) AS k FROM n JOIN t ON t.vec_id = n.vec_id WHERE v < fl + 0.5 * (lv - fl)),
a AS (SELECT DISTINCT n.vec_id, lv - fl AS rng FROM n JOIN t ON t.vec_id = n.vec_id)
SELECT a.vec_id, {sql_round('CASE WHEN rng < 3 OR xx IS NULL THEN 4 ELSE xx + CASE WHEN nx IS NULL THEN 0 WHEN nx <> v THEN (level - v) / (nx - v) ELSE 0.5 END END', 5)} AS edge_x
FROM a LEFT JOIN h ON h.vec_id = a.vec_id AND k = 1""",
)
def subpixel_edge(spark, sf_dir):
    profile = pixels.column_profile(pixel_rows(spark, sf_dir), ["vec_id"], "xx", "v").withColumn("edge", F.lit(4))
    out = pixels.subpixel_edge(profile, ["vec_id"], "xx", "profile", "edge")
    return out.select("vec_id", rounded("edge_x", 5).alias("edge_x"))


@query(
    "otsu_hist",
    "X8",
    """
WITH c AS (SELECT l_returnflag, CAST(l_quantity * 5 AS BIGINT) AS level, count(*)::DOUBLE AS c FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(c) OVER w AS w0, sum(level * c) OVER w AS m0, sum(c) OVER (PARTITION BY l_returnflag) AS n, sum(level * c) OVER (PARTITION BY l_returnflag) AS m
  FROM c WINDOW w AS (PARTITION BY l_returnflag ORDER BY level)),
s AS (SELECT *, coalesce(w0 * (n - w0) * pow(m0 / w0 - (m - m0) / nullif(n - w0, 0), 2), 0) AS b FROM r)
SELECT l_returnflag, arg_max(level, (floor(b * 1e-3), -level)) AS threshold FROM s GROUP BY l_returnflag
""",
)
def otsu_hist(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 5).cast("long").alias("level"))
    return pixels.histogram_threshold(rows, ["l_returnflag"], "level")


@query("max_projection", "X9", PIXELS + f"SELECT label, yy, xx, {sql_round('max(v)')} AS projected FROM px GROUP BY label, yy, xx")
def max_projection(spark, sf_dir):
    out = pixels.max_projection(pixel_rows(spark, sf_dir), ["label", "yy", "xx"], "v")
    return out.select("label", "yy", "xx", rounded("projected").alias("projected"))


@query(
    "channel_frames",
    "S11 S17 O1 J14",
    FILES
    + """, n AS (SELECT *, CASE WHEN contains(name, 'C1_') THEN 'c1' WHEN contains(name, 'frame') THEN 'c2' WHEN contains(name, 'run_') THEN 'c3' END AS channel,
    coalesce(TRY_CAST(coalesce(nullif(regexp_extract(name, '_t([0-9]+)', 1), ''), nullif(regexp_extract(name, '([0-9]+)\\.(tif|tiff)$', 1, 'i'), '')) AS BIGINT), 0) AS number
  FROM f WHERE regexp_matches(lower(name), '\\.tiff?$')),
r AS (SELECT *, row_number() OVER (PARTITION BY source, channel ORDER BY number, name) - 1 AS frame, count(*) OVER (PARTITION BY source, channel) AS cnt FROM n WHERE channel IS NOT NULL)
SELECT doc_id, source, channel, frame FROM r QUALIFY frame < min(cnt) OVER (PARTITION BY source)""",
)
def channel_frames(spark, sf_dir):
    rows = M.images(file_names(spark, sf_dir))
    out = M.channel_frames(rows, ["source"], {"c1": "C1_", "c2": "frame", "c3": "run_"})
    return out.select("doc_id", "source", "channel", "frame")


NAMED_TIMES = """
WITH d AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS frame, o_orderdate FROM orders),
nm AS (SELECT *, CASE o_custkey % 4 WHEN 0 THEN 'a_' || strftime(o_orderdate, '%Y-%m-%d') || '_01-02-03.tif' WHEN 1 THEN 'a_' || strftime(o_orderdate, '%Y%m%d') || '_040506.tif'
  WHEN 2 THEN 'a_t' || (frame * 140) || 'ms.tif' ELSE CASE WHEN frame % 2 = 0 THEN 'a_' || frame || 's_x.tif' ELSE 'plain.tif' END END AS name FROM d),
g AS (SELECT *, min(frame) OVER (PARTITION BY o_custkey) AS f0, first(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY frame) AS d0, count(*) OVER (PARTITION BY o_custkey) AS n FROM nm)
"""


@query(
    "name_times",
    "S12 S13",
    NAMED_TIMES
    + f"""SELECT o_orderkey, {sql_round('CASE WHEN o_custkey % 4 < 2 THEN (epoch_us(o_orderdate) - epoch_us(d0)) / 1e6 WHEN o_custkey % 4 = 2 THEN frame * 140 / 1000 WHEN n = 1 THEN frame ELSE frame * 0.2::DOUBLE END')} AS time_s,
  CASE o_custkey % 4 WHEN 0 THEN 'dashed' WHEN 1 THEN 'compact' WHEN 2 THEN 'milliseconds' ELSE CASE WHEN n = 1 THEN 'seconds' ELSE 'manual' END END AS time_source FROM g""",
)
def name_times(spark, sf_dir):
    from sparktraces.operators.sequence import number_rows

    rows = number_rows(
        table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderkey"], "o_orderkey"
    )
    k, f = F.col("o_custkey") % 4, F.col("frame")
    day = F.col("o_orderdate")
    name = (
        F.when(k == 0, F.concat(F.lit("a_"), F.date_format(day, "yyyy-MM-dd"), F.lit("_01-02-03.tif")))
        .when(k == 1, F.concat(F.lit("a_"), F.date_format(day, "yyyyMMdd"), F.lit("_040506.tif")))
        .when(k == 2, F.concat(F.lit("a_t"), (f * 140).cast("string"), F.lit("ms.tif")))
        .when(f % 2 == 0, F.concat(F.lit("a_"), f.cast("string"), F.lit("s_x.tif")))
        .otherwise("plain.tif")
    )
    out = M.name_times(rows.withColumn("name", name), ["o_custkey"])
    return out.select("o_orderkey", rounded("time_s").alias("time_s"), "time_source")


@query(
    "black_tail",
    "S14",
    "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY NOT (l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AND l_discount * 20 < 1.0)",
)
def black_tail(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 20).alias("mean"))
    return M.without_black_tail(rows, ["l_orderkey"], "mean", frame="l_linenumber").select("l_orderkey", "l_linenumber")
