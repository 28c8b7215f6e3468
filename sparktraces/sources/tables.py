"""Readers for trace files and the small tables around them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktraces.functions.measures import missing
from sparktraces.operators.stage import lookup_side, staged

# Column names by priority, and the bundle's file names.
TIME_COLUMNS = ["Time_s", "Time", "time_s"]
BUNDLE = ["mechanics", "attrition", "traces_protrusion", "traces_actin", "traces_uptake"]
STATUSES = ["I", "R0", "R", "D", "E"]


def _text_lines(spark: SparkSession, root: str, glob: str, comment: str) -> DataFrame:
    """(path, value, place) of every line that is no comment and not blank; places rise within a file."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    # lines of one split are read in order by one task, so the running id orders them
    place = F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), place.alias("place"))
    return lines.filter(~F.startswith(F.col("value"), F.lit(comment)) & (F.trim("value") != ""))


def trace_headers(spark: SparkSession, root: str, *, glob: str = "*.csv", comment: str = "#") -> DataFrame:
    """(path, names, n_lines): the cells of the first line of each file that is no comment, and the lines after it."""
    heads = _text_lines(spark, root, glob, comment).groupBy("path").agg(
        F.min_by("value", "place").alias("header"), (F.count(F.lit(1)) - 1).alias("n_lines")
    )
    # a quoted comma is no separator; names lose their quotes and outer blanks
    cells = F.split("header", ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    names = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.trim(c), '^\ufeff?"?|"$', "")))
    return heads.select("path", names.alias("names"), "n_lines")


def read_traces(
    spark: SparkSession, root: str, *, glob: str = "*.csv", comment: str = "#",
    rename: Callable[[str], str | None] | None = None, text: Sequence[str] = (),
) -> DataFrame:
    """Rows of all trace files below ``root`` as doubles, matched by header name.

    The header of a file is its first line that is no comment, whatever its cells hold. Files may have different
    headers: one scan reads all files by position, and each row finds its columns through its file's header, absent
    ones NULL. Cells that are not numbers become NULL and the row stays; the columns in ``text`` keep
    their strings. ``rename`` maps a header name to the wanted column, or to None to leave it out. Adds path,
    experiment (the folder, also as written by ``partitionBy("experiment")``) and trap_id, which take the place of
    columns of the same name.
    """
    heads = staged(trace_headers(spark, root, glob=glob, comment=comment))
    width = heads.agg(F.max(F.size("names"))).first()[0]
    if not width:
        return spark.createDataFrame([], "path STRING, experiment STRING, trap_id INT")
    # the distinct names become the columns of the result, so the driver has to know them
    found = sorted(r[0] for r in heads.select(F.explode("names")).distinct().collect())
    targets: dict[str, list[str]] = {}
    for name in found:
        target = rename(name) if rename else name
        if target and target not in ("path", "experiment", "trap_id"):
            targets.setdefault(target, []).append(name)
    schema = ", ".join(f"`c{i}` STRING" for i in range(width))
    rows = (
        spark.read.schema(schema).option("header", "true").option("comment", comment)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).csv(root)
        .select(F.array(*[f"c{i}" for i in range(width)]).alias("cells"), F.col("_metadata.file_path").alias("path"))
    )
    named = lookup_side(heads.select(F.col("path").alias("_path"), "names"))
    rows = rows.join(named, F.col("path") == F.col("_path"))

    def cell(names: list[str]) -> Column:
        """The first of the names that the file has."""
        places = [F.array_position("names", F.lit(n)) for n in names]
        return F.coalesce(*[F.when(at > 0, F.get("cells", (at - 1).cast("int"))) for at in places])

    columns = [
        (F.nullif(F.trim(cell(names)), F.lit("")) if target in text else missing(cell(names))).alias(target)
        for target, names in targets.items()
    ]
    out = rows.select("path", *columns)
    steps = F.split("path", "/")
    trap = F.nullif(F.regexp_extract(F.element_at(steps, -1), r"(?i)trap_(\d+)", 1), F.lit("")).cast("int")
    folder = F.regexp_replace(F.url_decode(F.element_at(steps, -2)), "^experiment=", "")
    return out.withColumn("experiment", folder).withColumn("trap_id", trap)


def rejected_traces(spark: SparkSession, root: str, required: Sequence[str], *, glob: str = "*.csv", comment: str = "#") -> DataFrame:
    """(path, reason) of files that give no trace: "empty", "missing columns" or "no rows"."""
    heads = trace_headers(spark, root, glob=glob, comment=comment).withColumnRenamed("path", "_path")
    # the driver's file index is the one place that lists files of no length; scans leave them out
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root).inputFiles()
    listed = spark.createDataFrame([(f,) for f in files], "path STRING")
    have = F.size(F.array_intersect("names", F.array(*[F.lit(c) for c in required]))) == len(required)
    reason = (
        F.when(F.col("names").isNull(), "empty").when(~have, "missing columns").when(F.col("n_lines") == 0, "no rows")
    )
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  file:/ and file:/// are one
    joined = listed.join(heads, plain("path") == plain("_path"), "left")
    return joined.select("path", reason.alias("reason")).filter("reason is not null")


def sniffed(name: str) -> str | None:
    """Header rule for files of unknown layout: a time column and a length column, by substring."""
    low = name.lower()
    if "time" in low:
        return "t"
    if "length" in low or "protrusion" in low:
        return "length"
    return None


def first_available(df: DataFrame, names: Sequence[str], *substrings: str) -> Column:
    """Value of the first present column by ordered names, then of columns holding a substring."""
    have = [n for n in names if n in df.columns]
    have += [c for s in substrings for c in df.columns if s in c.lower() and c not in have]
    return F.coalesce(*[F.col(c) for c in have]) if have else F.lit(None).cast("double")


def present_columns(df: DataFrame, groups: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Per group: whether each region's column holds any value."""
    return df.groupBy(*groups).agg(
        *[
            (F.bool_or(F.col(c).isNotNull()) if c in df.columns else F.lit(False)).alias(f"has_{r}")
            for r, c in columns.items()
        ]
    )


def first_scalar(df: DataFrame, value: str, *, experiment: str = "experiment", path: str = "path") -> DataFrame:
    """One scalar per experiment from the first file by name."""
    return df.groupBy(experiment).agg(F.min_by(value, path).alias(value))


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Status overview: semicolon text whose columns 0, 3, 4, 10 and 11 hold date, chip, experiment, trap and status."""
    raw = spark.read.option("sep", ";").option("header", "true").option("encoding", "UTF-8").csv(path)
    c = [F.col(f"`{n}`") for n in raw.columns]
    status = F.upper(F.trim(c[11]))
    return (
        raw.select(
            F.trim(c[0]).alias("date"),
            F.trim(c[3]).try_cast("int").alias("chip_id"),
            F.trim(c[4]).alias("exp_id"),
            F.trim(c[10]).try_cast("int").alias("trap_id"),
            status.alias("status"),
        )
        .filter(F.col("status").isin(*STATUSES))
        .na.drop(subset=["chip_id", "trap_id"])
    )


def read_bundle(spark: SparkSession, root: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """The named tables of a bundle, each a CSV file ``<name>.csv`` or a Parquet folder; an absent one is empty."""
    out = {}
    for name, schema in schemas.items():
        parsed = T.StructType.fromDDL(schema)
        places = {kind: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}{end}") for kind, end in (("csv", ".csv"), ("parquet", ""))}
        there = [k for k, p in places.items() if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
        if not there:
            out[name] = spark.createDataFrame([], parsed)
        elif there[0] == "csv":
            # columns by name: the file may hold others, in any order
            raw = spark.read.option("header", "true").csv(f"{root}/{name}.csv")
            have = {c.strip().lstrip("\ufeff"): c for c in raw.columns}
            out[name] = raw.select(
                *[
                    (F.col(f"`{have[f.name]}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
                    for f in parsed
                ]
            )
        else:
            out[name] = spark.read.schema(parsed).parquet(f"{root}/{name}")
    return out


def cut_to_shorter(left: DataFrame, right: DataFrame, keys: Sequence[str], *, frame: str = "frame") -> tuple[DataFrame, DataFrame]:
    """Rows of both tables on the same frame, and per trace how many rows either side has beyond the other."""
    keys = list(keys)
    joined = left.join(right, [*keys, frame])
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), keys, "full")
    over = F.coalesce("_l", F.lit(0)) - F.coalesce("_r", F.lit(0))
    return joined, counts.select(*keys, F.greatest(over, F.lit(0)).alias("left_surplus"), F.greatest(-over, F.lit(0)).alias("right_surplus"))


def rebuild(protrusion: DataFrame, keys: Sequence[str], **channels: DataFrame) -> DataFrame:
    """Protrusion rows with the rows of optional channels on the same frame."""
    out = protrusion
    for name, df in channels.items():
        renamed = df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys])
        out = out.join(renamed, list(keys), "left")
    return out
