"""Parsing and building of text labels, as Column -> Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The experiment folder grammar, one capture group per field.
FOLDER_GRAMMAR = (
    r"(?i)^(\d{6})_([^_\-]+)_([^_\-]+)_([^_\-]+)_([^_\-]+)"
    r"[-_](\d+)Pa[-_](\d+)V[-_](\d+)(ms|us|µs|μs|s)[-_]frame(\d+)"
)

# File-name endings that annotate the outcome of a trace.
ANALYSED_TAGS = {"_R": "ruptured_post"}
UNTAGGED_FATE = "intact"
EXCLUDED_TAGS = {
    "_R0": "ruptured_pre_pulse",
    "_DOA": "not_viable",
    "_PI": "not_viable",
    "_R_DOA": "not_viable",
    "_R0_DOA": "not_viable",
    "_after": "post_pulse_arrival",
    "_POST": "post_pulse_arrival",
    "_MASK": "detection_failure",
    "_SHAPE": "detection_failure",
    "_IRREGULAR": "detection_failure",
}

# The six outcome buckets in report order.
BUCKETS = [
    "analysed_intact",
    "analysed_ruptured",
    "ruptured_pre_pulse",
    "not_viable",
    "post_pulse_arrival",
    "detection_failure",
]

# Accepted spellings of a region.
REGION_ALIASES = {
    "Body": "Body",
    "body": "Body",
    "Prot": "Protrusion",
    "prot": "Protrusion",
    "Protrusion": "Protrusion",
    "protrusion": "Protrusion",
}

# Treatments in search order, and doses by image number.
TREATMENTS = ["cntrl", "ck666", "smifh2", "cytd", "dmso"]
DOSES_UM = {
    "CK666": {1: 50.0, 2: 100.0, 3: 150.0, 4: 200.0},
    "SMIFH2": {1: 5.0, 2: 25.0, 3: 40.0, 4: 80.0},
    "CYTD": {1: 0.1, 2: 0.25, 3: 0.50, 4: 1.0},
    "DMSO": {1: 0.0, 2: 50.0, 3: 100.0, 4: 200.0},
    "CNTRL": {1: 0.0},
}

PROTOCOLS = ["5ms", "100us"]


def duration_ms(value: Column, unit: Column) -> Column:
    """Milliseconds from a number and a unit of s, ms, us or micro-s."""
    u = canonical_unit(unit)
    return F.when(u == "s", value * 1000.0).when(u == "us", value / 1000.0).otherwise(value)


def canonical_unit(unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin("µs", "μs"), F.lit("us")).otherwise(u)


def duration_label(value: Column, unit: Column) -> Column:
    """'5ms' for a whole number, '2.5ms' otherwise."""
    number = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(
        value.cast("string")
    )
    return F.concat(number, canonical_unit(unit))


def condition_type(voltage: Column) -> Column:
    return F.when(voltage == 0, F.lit("ASP")).otherwise(F.lit("EP"))


def parse_folder(name: Column) -> Column:
    """Struct of experiment fields; NULL when the name does not follow the grammar."""
    sep = "\x01"
    split = F.split(
        F.regexp_replace(name, FOLDER_GRAMMAR + r"[\s\S]*$", sep.join(f"${i}" for i in range(1, 11))), sep
    )

    def fields_of(fields: Column) -> Column:
        value, unit = fields[7].cast("double"), fields[8]
        volts = fields[6].cast("int")
        return F.when(
            F.size(fields) == 10,
            F.struct(
                fields[0].alias("date"),
                fields[1].alias("cell_type"),
                fields[2].alias("treatment"),
                fields[3].alias("chip"),
                fields[4].alias("experiment_number"),
                fields[5].cast("int").alias("pressure_pa"),
                volts.alias("voltage_v"),
                duration_ms(value, unit).alias("duration_ms"),
                duration_label(value, unit).alias("duration_label"),
                fields[9].cast("int").alias("pulse_frame"),
                condition_type(volts).alias("condition_type"),
            ),
        )

    # a variable of a lambda: the name is matched once, however many fields are read from it
    return F.get(F.transform(F.array(split), fields_of), F.lit(0))


def parsed_folders(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` whose folder name follows the grammar, with its fields."""
    # generated rows, not a filter beside a column: either would match the name again
    return df.select("*", F.inline(F.array_compact(F.array(parse_folder(F.col(name))))))


def outcome_tag(stem: Column, *, unknown: str = UNTAGGED_FATE) -> Column:
    """Struct (kind, key) from the longest known tag that ends the stem."""
    known = [(t, "analysis", k) for t, k in ANALYSED_TAGS.items()]
    known += [(t, "exclusion", k) for t, k in EXCLUDED_TAGS.items()]
    low = F.lower(stem)

    def pair(kind: str, key: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"))

    pairs = sorted(known, key=lambda k: -len(k[0]))
    case = F.when(low.endswith(pairs[0][0].lower()), pair(*pairs[0][1:]))
    for tag, kind, key in pairs[1:]:
        case = case.when(low.endswith(tag.lower()), pair(kind, key))
    return case.otherwise(pair("analysis", unknown))


def outcome_bucket(stem: Column) -> Column:
    """One of `BUCKETS` for a candidate file."""
    tag = outcome_tag(stem)
    return (
        F.when(tag["kind"] == "exclusion", tag["key"])
        .when(tag["key"] == "ruptured_post", F.lit("analysed_ruptured"))
        .otherwise(F.lit("analysed_intact"))
    )


def condition_label(
    cell_type: Column, treatment: Column, pressure: Column, condition: Column, voltage: Column, duration: Column
) -> Column:
    stem = F.concat_ws("_", cell_type, treatment, F.concat(pressure.cast("string"), F.lit("Pa")))
    pulsed = F.concat_ws("_", stem, F.concat(voltage.cast("string"), F.lit("V")), duration)
    return F.when(condition == "ASP", F.concat_ws("_", stem, F.lit("ASP"))).otherwise(pulsed)


def display_label(
    condition: Column,
    voltage: Column,
    duration: Column,
    fate: Column,
    *,
    with_fate: bool = False,
    include_voltage: bool = True,
    pre_post: bool = False,
) -> Column:
    """Reader-facing condition text, e.g. '100 V, 5 ms (Intact)'."""
    shown_fate = F.when(F.lower(fate) == "intact", "Intact").when(F.lower(fate) == "ruptured_post", "Ruptured")
    if pre_post:
        return F.coalesce(F.concat(shown_fate, F.lit(" pre/post")), F.lit("pre/post"))
    shown_duration = (
        F.when(duration.isin("100us", "100µs"), "100 µs")
        .when(duration == "5ms", "5 ms")
        .otherwise(F.coalesce(duration, F.lit("")))
    )
    pulsed = shown_duration
    if include_voltage:
        pulsed = F.coalesce(
            F.concat(voltage.cast("int").cast("string"), F.lit(" V, "), shown_duration), shown_duration
        )
    base = F.when(F.upper(condition) == "ASP", F.lit("No pulse")).otherwise(pulsed)
    if with_fate:
        return F.coalesce(F.concat(base, F.lit(" ("), shown_fate, F.lit(")")), base)
    return base


def bucket_label(
    condition: Column,
    voltage: Column,
    duration: Column,
    *,
    fate: Column | None = None,
    phase: Column | None = None,
) -> Column:
    """'ASP' or 'EP-<phase> <V>V <duration>', with '(intact)' / '(ruptured)' when ``fate`` is given."""
    prefix = F.concat(F.lit("EP-"), phase if phase is not None else F.lit("pre"))
    parts = [prefix, F.concat(voltage.cast("string"), F.lit("V")), duration]
    if fate is not None:
        parts.append(F.when(fate == "ruptured_post", "(ruptured)").otherwise("(intact)"))
    return F.when(condition == "ASP", F.lit("ASP")).otherwise(F.concat_ws(" ", *parts))


def phase_of_entry(entered_after_marker: Column) -> Column:
    """Bucket phase of the whole-trace labels."""
    return F.when(F.coalesce(entered_after_marker, F.lit(False)), "post").otherwise("whole")


def compact_fate_label(duration: Column, fate: Column) -> Column:
    short = F.when(fate == "ruptured_post", "ruptured").otherwise(F.coalesce(fate, F.lit("?")))
    return F.concat_ws("_", F.coalesce(duration, F.lit("?")), short)


def fate_box_label(condition: Column, treatment: Column, duration: Column, fate: Column) -> Column:
    control = F.concat(F.lit("ASP_"), F.coalesce(treatment, F.lit("?")))
    return F.when(condition == "ASP", control).otherwise(compact_fate_label(duration, fate))


def treatment_label(condition: Column, treatment: Column, duration: Column, fate: Column) -> Column:
    """Superplot category: controls by treatment, pulsed traces by duration and fate."""
    label = display_label(condition, F.lit(None).cast("int"), duration, fate, with_fate=True, include_voltage=False)
    control = F.when(treatment == "WT", F.lit("No pulse")).otherwise(
        F.concat(F.lit("No pulse ("), treatment, F.lit(")"))
    )
    return F.when(F.upper(condition) == "ASP", control).otherwise(label)


def parse_bucket(label: Column) -> Column:
    """Struct (protocol, fate) back from a bucket label; anything unknown is a control."""
    low = F.lower(label)
    protocol = F.when(low.contains("100us"), "100us").when(low.contains("5ms"), "5ms").otherwise("ASP")
    fate = F.when((protocol != "ASP") & low.contains("(ruptured)"), "ruptured_post").otherwise("intact")
    return F.struct(protocol.alias("protocol"), fate.alias("fate"))


def chip_id(folder: Column) -> Column:
    hits = F.filter(F.split(folder, "_"), lambda token: token.startswith("Chip"))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit("Unknown"))


def protocol_key(condition: Column, duration: Column) -> Column:
    """ASP for controls, otherwise the duration label unchanged."""
    return F.when(condition == "ASP", F.lit("ASP")).otherwise(duration)


def arm_key(condition: Column, duration: Column) -> Column:
    """ASP, 5ms or 100us; NULL for anything else."""
    return F.when(condition == "ASP", F.lit("ASP")).when(
        (condition == "EP") & duration.isin(*PROTOCOLS), duration
    )


def duration_sort_key(label: Column) -> Column:
    """Numeric milliseconds of a label such as '100us'; infinity when it cannot be read."""
    low = F.lower(F.trim(label))
    unit = F.regexp_extract(low, r"(us|ms|s)$", 1)
    number = F.regexp_extract(low, r"^(.*?)(us|ms|s)$", 1).try_cast("double")
    scaled = F.when(unit == "us", number * 1e-3).when(unit == "ms", number).when(unit == "s", number * 1e3)
    return F.coalesce(scaled, F.lit(float("inf")))


def frame_number(file_name: Column) -> Column:
    """Number after '_t', else the digits before .tif / .tiff, else NULL."""
    after_t = F.regexp_extract(file_name, r"_t(\d+)", 1)
    trailing = F.regexp_extract(file_name, r"(?i)(\d+)\.(?:tif|tiff)$", 1)
    return F.coalesce(F.nullif(after_t, F.lit("")), F.nullif(trailing, F.lit(""))).cast("long")


def marker_index(marker: Column, first_frame: Column) -> Column:
    """0-based row of a marker given the number on the first file (1 when unknown)."""
    return F.greatest(F.lit(0), F.coalesce(marker, F.lit(0)) - F.coalesce(first_frame, F.lit(1)))


def resolve_region(region: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in REGION_ALIASES.items() for x in pair])
    hit = F.try_element_at(known, region)
    return F.when(hit.isNotNull(), hit).otherwise(
        F.raise_error(F.concat(F.lit("unknown region "), F.coalesce(region, F.lit("NULL")))).cast("string")
    )


def treatment_and_dose(file_name: Column) -> Column:
    """Struct (treatment, dose_um): the first treatment named and the dose of the image number."""
    low = F.lower(file_name)
    found = F.when(low.contains(TREATMENTS[0]), TREATMENTS[0].upper())
    for t in TREATMENTS[1:]:
        found = found.when(low.contains(t), t.upper())
    number = F.nullif(F.regexp_extract(low, r"image[_\s]*(\d+)", 1), F.lit(""))
    doses = F.create_map(
        *[F.lit(x) for t, table in DOSES_UM.items() for n, d in table.items() for x in (f"{t}/{n}", d)]
    )
    dose = F.coalesce(F.try_element_at(doses, F.concat_ws("/", found, number.cast("int").cast("string"))), F.lit(0.0))
    named = found.when(number.isNull() & low.contains("control"), "CNTRL").otherwise("Unknown")
    return F.struct(named.alias("treatment"), dose.alias("dose_um"))


def remap(label: Column, mapping: DataFrame | Mapping[str, str]) -> Column:
    """Identity unless the (small, literal) mapping names another label."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), label)


def remap_by_experiment(df: DataFrame, mapping: DataFrame, experiment: str, label: str) -> DataFrame:
    """Labels renamed by the rows (experiment, label, canonical) of ``mapping``; without a row a label stays as it is.

    A label with several rows takes the least of their names.
    """
    named = mapping.groupBy(F.col(experiment).alias("_e"), F.col(label).alias("_l")).agg(F.min("canonical").alias("_to"))
    same = F.col(experiment).eqNullSafe(F.col("_e")) & (F.col(label) == F.col("_l"))
    return df.join(named, same, "left").withColumn(label, F.coalesce("_to", F.col(label))).drop("_e", "_l", "_to")


def reduce_labels(df: DataFrame, label: str, *, sep: str = "_", out: str = "short_label") -> DataFrame:
    """Distinct labels with only the parts that vary across the set.

    Labels stay whole when there is one label, part counts differ or nothing varies.
    """
    labels = df.select(label).distinct()
    parts = labels.select(label, F.posexplode(F.split(F.col(label), sep)).alias("_pos", "_part"))
    per_part = parts.groupBy("_pos").agg(F.min("_part").alias("_a"), F.max("_part").alias("_b"))
    varying = per_part.agg(
        F.array_sort(F.collect_list(F.when(F.col("_a") != F.col("_b"), F.col("_pos")))).alias("v")
    )
    shape = labels.select(F.size(F.split(F.col(label), sep)).alias("k")).agg(
        F.struct(F.min("k").alias("lo"), F.max("k").alias("hi")).alias("s")
    )
    split = F.split(F.col(label), sep)
    short = F.array_join(F.transform(F.col("_v"), lambda i: split[i]), sep)
    return (
        labels.withColumn("_v", varying.scalar())
        .withColumn("_s", shape.scalar())
        .select(
            label,
            F.when((F.col("_s.lo") == F.col("_s.hi")) & (F.size("_v") > 0), short)
            .otherwise(F.col(label))
            .alias(out),
        )
    )


def dominant_label(df: DataFrame, groups: Sequence[str], order: str, *candidates: str, known: Sequence[str], default: str) -> DataFrame:
    """First known label per group, candidates tried in order on each row."""
    hit = F.coalesce(*[F.when(F.col(c).isin(*known), F.col(c)) for c in candidates])
    return df.groupBy(*groups).agg(
        F.coalesce(F.min_by(hit, F.when(hit.isNotNull(), F.col(order))), F.lit(default)).alias("dominant")
    )
