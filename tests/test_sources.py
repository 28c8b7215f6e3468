"""Reading trace folders and small tables, and writing results, on files made here."""

import pytest
from pyspark.sql import functions as F

from sparktraces.operators.sequence import summarise
from sparktraces.operators.stage import staged
from sparktraces.sources import folder_source, manifest, sinks, tables

FOLDER = "260128_MDAMB231_WT_Chip1_Experiment3-1100Pa-100V-5ms-frame10"
OTHER = "260129_MDAMB231_CytD_Chip2_Experiment4-1100Pa-0V-5ms-frame0"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("runs")
    for name in (FOLDER, OTHER, "notes"):
        (top / name).mkdir()
    (top / FOLDER / "trap_01_detection_full.csv").write_text("# run 1\nFrame,Time_s,Protrusion_Length_um\n0,0.0,1.5\n1,0.2,bad\n2,0.4,nan\n")
    (top / FOLDER / "trap_02_detection_full_R.csv").write_text("Time_s,Frame,Body_Area_um2\n0.0,0,50\n0.2,1,51\n")
    (top / OTHER / "trap_7_detection_full_DOA.csv").write_text("Frame,Time_s,Protrusion_Length_um\n0,0.0,2.5\n")
    (top / OTHER / "Trap_07_Uptake.csv").write_text("Time_s,Body_Intensity\n0.0,3\n")
    (top / OTHER / "Trap_7_Uptake.csv").write_text("Time_s,Body_Intensity\n0.0,4\n")
    (top / OTHER / "summary_fits.csv").write_text("Trap,R2\n1,0.9\n")
    return str(top)


def test_folders_that_follow_the_grammar(spark, root):
    got = {r.experiment: r for r in manifest.experiments(manifest.files(spark, root, "*.csv")).collect()}
    assert set(got) == {FOLDER, OTHER}
    assert got[FOLDER].voltage_v == 100 and got[OTHER].condition_type == "ASP"


def test_traces_with_different_headers(spark, root):
    rows = tables.read_traces(spark, root, glob="trap_*_detection_full*.csv")
    got = {(r.experiment, r.trap_id, int(r.Frame)): r for r in rows.collect()}
    assert len(got) == 6
    assert got[FOLDER, 1, 0].Protrusion_Length_um == 1.5 and got[FOLDER, 1, 0].Body_Area_um2 is None
    assert got[FOLDER, 1, 1].Protrusion_Length_um is None and got[FOLDER, 1, 2].Protrusion_Length_um is None
    assert got[FOLDER, 2, 1].Time_s == 0.2 and got[FOLDER, 2, 1].Body_Area_um2 == 51.0
    assert got[OTHER, 7, 0].Protrusion_Length_um == 2.5


def test_header_is_the_first_line_whatever_it_holds(spark, tmp_path):
    folder = tmp_path / "run"
    folder.mkdir()
    (folder / "trap_1.csv").write_text("# note\n\nTime_s,Length\n0,1\nBad,2\n2,3\n")
    (folder / "trap_2.csv").write_text('\ufeffgroup,Time_s,"Length, um"\nexpA,0,1\n"exp,B",1,2\nexpC,,x\n')
    (folder / "trap_3.csv").write_text("# nothing but a note\n")
    (folder / "trap_4.csv").write_text("Time_s,Other\n1,2\n")
    (folder / "trap_5.csv").write_text("Time_s,Length\n")
    (folder / "trap_6.csv").write_text("")
    rows = tables.read_traces(spark, str(tmp_path), text=["group"]).orderBy("trap_id", F.col("Time_s").asc_nulls_last()).collect()
    assert [(r.trap_id, r.Time_s, r.Length) for r in rows if r.trap_id == 1] == [(1, 0.0, 1.0), (1, 2.0, 3.0), (1, None, 2.0)]
    assert [(r.group, r.Time_s, r["Length, um"]) for r in rows if r.trap_id == 2] == [("expA", 0.0, 1.0), ("exp,B", 1.0, 2.0), ("expC", None, None)]
    assert {r.trap_id for r in rows} == {1, 2, 4} and len(rows) == 7
    found = tables.rejected_traces(spark, str(tmp_path), ["Time_s", "Length"]).collect()
    assert {(r.path[-10:], r.reason) for r in found} == {
        ("trap_2.csv", "missing columns"), ("trap_3.csv", "empty"), ("trap_4.csv", "missing columns"), ("trap_5.csv", "no rows"), ("trap_6.csv", "empty")
    }


def test_bundle_of_csv_files(spark, tmp_path):
    (tmp_path / "mechanics.csv").write_text("extra,trap_id,experiment\nx,3,e\ny,bad,f\n")
    got = tables.read_bundle(spark, str(tmp_path), {"mechanics": "experiment STRING, trap_id INT, absent DOUBLE", "attrition": "experiment STRING"})
    assert [tuple(r) for r in got["mechanics"].orderBy("experiment").collect()] == [("e", 3, None), ("f", None, None)]
    assert got["attrition"].count() == 0


def test_row_index_join_is_cut_to_the_shorter(spark):
    left = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)], "k string, frame int, x double")
    right = spark.createDataFrame([("a", 0, 5.0), ("b", 0, 6.0), ("b", 1, 7.0), ("c", 0, 8.0)], "k string, frame int, y double")
    both, surplus = tables.cut_to_shorter(left, right, ["k"])
    assert {tuple(r) for r in both.collect()} == {("a", 0, 1.0, 5.0), ("b", 0, 3.0, 6.0)}
    assert {tuple(r) for r in surplus.collect()} == {("a", 1, 0), ("b", 0, 1), ("c", 0, 1)}


def test_sniffed_columns(spark, root):
    rows = tables.read_traces(spark, root, glob="trap_0*_detection_full*.csv", rename=tables.sniffed)
    assert {"t", "length"} <= set(rows.columns) and "Frame" not in rows.columns
    assert rows.filter(F.col("length").isNotNull()).count() == 1


def test_no_files_give_an_empty_table(spark, root):
    assert tables.read_traces(spark, root, glob="none_*.csv").count() == 0


def test_padded_side_file_wins(spark, root):
    got = manifest.preferred_side_files(manifest.files(spark, root, "[Tt]rap_*_Uptake*.csv")).collect()
    assert [(r.trap_id, r.name) for r in got] == [(7, "Trap_07_Uptake.csv")]


def test_summaries_are_skipped(spark, root):
    names = [r.name for r in manifest.data_files(manifest.files(spark, root, "*.csv")).collect()]
    assert "summary_fits.csv" not in names and len(names) == 5


def test_first_scalar_by_name(spark):
    df = spark.createDataFrame([("a", "f2", 0.7), ("a", "f1", 0.6), ("b", "f1", 0.5)], "experiment string, path string, fstar double")
    assert {r.experiment: r.fstar for r in tables.first_scalar(df, "fstar").collect()} == {"a": 0.6, "b": 0.5}


def test_status_by_position(spark, tmp_path):
    head = ";".join(f"h{i}" for i in range(12))
    line = "260128;x;x;1;E3;x;x;x;x;x;{};{}"
    text = "﻿" + "\n".join([head, line.format(5, " r0 "), line.format("x", "D"), line.format(6, "unknown")])
    path = tmp_path / "status.csv"
    path.write_text(text, encoding="utf-8")
    got = tables.read_status(spark, str(path)).collect()
    assert [(r.chip_id, r.trap_id, r.status) for r in got] == [(1, 5, "R0")]


def test_absent_bundle_table_is_empty(spark, tmp_path):
    full = spark.createDataFrame([("e", 1)], "experiment string, trap_id int")
    sinks.write_bundle({"mechanics": full, "attrition": full.limit(0)}, str(tmp_path))
    got = tables.read_bundle(spark, str(tmp_path), {"mechanics": "experiment STRING, trap_id INT", "attrition": "experiment STRING"})
    assert got["mechanics"].count() == 1 and got["attrition"].count() == 0


def test_traces_keep_their_column_order(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "prot", 0.5, 3, "e")], "length double, channel string, time_s double, trap_id int, experiment string")
    assert sinks.ordered(df).columns == ["experiment", "trap_id", "time_s", "length", "channel"]
    sinks.write_traces(df, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/traces").filter("channel = 'prot'").count() == 1


def test_rejected_columns(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, None), (1, 1.0, None, None)], "k int, t double, a double, b double")
    got = {r.column: r.reason for r in sinks.rejected_columns(df, ["k"], ["a", "b"], "t").collect()}
    assert got == {"a": "wrong length", "b": "no values"}


def test_detection_full_and_filtered(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("frame"), F.lit(4).alias("event"))
    sinks.write_detection(df, "event", str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/detection_full").count() == 10
    assert spark.read.parquet(f"{tmp_path}/detection_filtered").count() == 5


def test_kymograph_there_and_back(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0])], "frame int, p array<double>")
    wide = sinks.kymograph_wide(sinks.kymograph_long(df, ["frame"], "p", scale=0.5, width=3), ["frame"], 3)
    assert [tuple(r) for r in wide.orderBy("frame").collect()] == [(0, 1.0, 2.0, 3.0), (1, 4.0, None, None)]


def test_feature_table_three_ways(spark):
    df = spark.createDataFrame([(1, "Pre_Leaky"), (2, None), (3, "ok")], "k int, qc string")
    parts = sinks.split_by_check(df, F.col("qc").isin("Pre_Leaky", "Pre_Loaded"))
    assert {n: p.count() for n, p in parts.items()} == {"all": 3, "excluded": 1, "kept": 2}


def test_column_priority(spark):
    df = spark.createDataFrame([(None, 2.0, 9.0), (1.0, 5.0, 9.0)], "Time double, time_s double, Cell_Body_x double")
    got = [r[0] for r in df.select(tables.first_available(df, tables.TIME_COLUMNS)).collect()]
    assert got == [2.0, 1.0]
    assert df.select(tables.first_available(df, ["Body"], "body")).first()[0] == 9.0
    seen = tables.present_columns(df, [], {"body": "Cell_Body_x", "tip": "none"}).first()
    assert seen.has_body and not seen.has_tip


def test_staged_rows_are_the_same(spark):
    df = spark.range(50).select("id", F.array(F.col("id").cast("double")).alias("a"))
    assert sorted(staged(df).collect()) == sorted(df.collect())


def test_fit_on_every_row(spark, tmp_path):
    df = spark.range(6).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("frame"), F.col("id").cast("double").alias("y"))
    out = sinks.with_fit(df, summarise(df, ["k"], F.max("y").alias("a")), ["k"])
    assert {(r.k, r.a) for r in out.collect()} == {(0, 4.0), (1, 5.0)} and out.count() == 6
    sinks.write_by(out, str(tmp_path / "by"), "k")
    assert spark.read.parquet(str(tmp_path / "by")).filter("k = 1").count() == 3


def test_folder_files_are_written_and_read_in_slices(spark, tmp_path):
    long = [("e1", "Trap_9_x", i, f"{i}.5") for i in range(30_000)]
    rows = long + [(f"e{k % 2}", f"Trap_{k}_x", i, None if i == 1 else f"{k}.25") for k in range(40) if k != 9 for i in range(3)]
    df = spark.createDataFrame(rows, "experiment string, file string, Frame long, Length string")
    root = f"file://{tmp_path}/folders"
    assert folder_source.write_files(df.repartition(7), root, ["experiment", "file"]) == 40
    bad = spark.createDataFrame([("e1", "Trap_77_x", 1, "2")], "experiment string, file string, Frame long, Width string")
    assert folder_source.write_files(bad, root, ["experiment", "file"]) == 1
    assert folder_source.write_files(bad.limit(0), root, ["experiment", "file"]) == 0
    folder_source.register(spark)
    for slices in (1, 5):
        source = spark.read.format("trace_folders").option("path", root).option("columns", "frame=Frame,length=Length").option("slices", slices)
        back = source.load()
        assert back.rdd.getNumPartitions() == 2 * slices
        got = back.select("experiment", F.concat(F.lit("Trap_"), "trap_id", F.lit("_x")), F.col("frame").cast("long"), "length").collect()
        assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
        report = source.option("report", "true").load().collect()
        assert [(r.experiment, r.reason) for r in report] == [("e1", "missing columns")]
