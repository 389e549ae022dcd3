"""Files in and out, validation and the stream."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from convoyspark.operators import validate
from convoyspark.plans import schema as s
from convoyspark.sinks import snapshots as sink
from convoyspark.sources import files, ingest, snapshots
from convoyspark.streaming import ingest as stream


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def plan_csv(columns=s.REQUIRED_COLUMNS, **cells):
    header = ",".join(columns)
    return header + "\n" + ",".join(str(cells.get(c, "")) for c in columns) + "\n"


def test_plans_with_aliases_and_line_breaks(spark, tmp_path):
    path = write(tmp_path / "p.csv", 'ID,Company,Number of haj,Period,path_name\n7,"a\nb",12,,x\n8,c,abc,3,\n')
    got = files.read_plans(spark, path).orderBy("_row").collect()
    assert [(r.plan_id, r.owner_company_name, r.number_of_haj, r.period, r._row) for r in got] == [
        ("7", "a\nb", 12.0, None, 0), ("8", "c", 0.0, "3", 1)]


def test_camps_with_a_broken_header(spark, tmp_path):
    path = write(tmp_path / "c.csv", '"camp_label","service_company_name","office_number","transport_mode\n","number_of_piligrim"\n1/2,x,3,bus,45\n')
    r = files.read_camps(spark, path).head()
    assert (r.camp_label, r.transport_mode, r.service_center_name, r.number_of_piligrim) == ("1/2", "bus", "3", 45.0)


def test_residences_with_bom_and_unnamed_columns(spark, tmp_path):
    path = write(tmp_path / "r.csv", "﻿License Number,Name,Pilgrims_count,Service_company,,\n 12 , Inn ,3,co,,\n")
    r = files.read_residences(spark, path).head()
    assert (r.license_number, r.residence_name, r.pilgrims_count, r.service_center_number) == ("12", "Inn", 3.0, "")


def test_missing_source(spark, tmp_path):
    assert files.read_cameras(spark, str(tmp_path / "none.json")).isEmpty()
    with pytest.raises(AnalysisException):
        files.read_cameras(spark, str(tmp_path / "none.json"), strict=True)


def test_features(spark, tmp_path):
    path = write(tmp_path / "d.geojson", '{"type":"FeatureCollection","features":[{"properties":{"discription":"D","x":1},'
                 '"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    r = files.districts(files.read_features(spark, path)).head()
    assert r.district_name == "D" and '"Point"' in r.geom_text


def test_validation(spark, tmp_path):
    columns = [c for c in s.REQUIRED_COLUMNS if c != "path_name"]
    bad = files.read_csv(spark, write(tmp_path / "a.csv", plan_csv(columns, number_of_buses="abc")), corrupt=True)
    got = {(r.check, r.column, r.value) for r in validate.all_findings(bad).collect()}
    assert got == {("missing column", "path_name", None), ("not numeric", "number_of_buses", "abc")}
    short = files.read_csv(spark, write(tmp_path / "b.csv", "a,b,c\n1,2,3\n1,2\n"), corrupt=True)
    assert validate.width_violations(short).count() == 1
    empty = files.read_csv(spark, write(tmp_path / "c.csv", "a,b\n"))
    assert validate.no_rows(empty).count() == 1 and validate.no_rows(short).count() == 0


def test_camera_export(spark, tmp_path):
    stats = spark.createDataFrame([("group", 'c"1', "t", "x", "co", "7", 2.0, 6.0), ("camera", 'c"1', None, None, None, None, 2.0, 6.0)],
                                  "level string, camera string, plan_type string, transport string, company string, center string, buses double, trips double")
    sink.write_camera_stats(stats, str(tmp_path / "out"), byte_order_mark=True)
    text = next((tmp_path / "out").glob("*.csv")).read_bytes().decode("utf-8")
    assert text.startswith('"﻿اسم الكاميرا"') and text.endswith('"c""1","t","x","co","7","2","6"\r\n')


def test_camera_export_compressed(spark, tmp_path):
    stats = spark.createDataFrame([("group", "c", "t", "x", "co", "7", 2.0, 6.0)], "level string, camera string, plan_type string, transport string, "
                                  "company string, center string, buses double, trips double")
    sink.write_camera_stats(stats, str(tmp_path / "out"), compression="gzip")
    assert [*(tmp_path / "out").glob("*.csv.gz")] and not [*(tmp_path / "out").glob("*.csv")]
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == [("c", "t", "x", "co", "7", "2", "6")]


def test_latest_file_and_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for day, n in (("01", 1), ("02", 2)):
        write(folder / f"assign_camps_{day}.csv", f"camp_label,office_number,number_of_piligrim\n1/1,2,{n}\n")
    assert snapshots.latest_file(spark, str(folder), "assign_camp").endswith("assign_camps_02.csv")
    done = ingest.ingest(spark, str(folder), str(tmp_path / "out"), "both")
    assert set(done) == {"camps"} and done["camps"].head().number_of_piligrim == 2
    with pytest.raises(FileNotFoundError):
        ingest.ingest(spark, str(folder), str(tmp_path / "out"), "residences")


def test_stream_keeps_the_newest_valid_load(spark, tmp_path):
    folder, target = tmp_path / "arrivals", str(tmp_path / "plans")
    folder.mkdir()

    def load(seq, buses):
        write(folder / f"plans_{seq}.csv", plan_csv(plan_id=seq, number_of_buses=buses))
        stream.start_ingest(stream.read_plan_stream(spark, str(folder)), target, str(tmp_path / "cp"), s.REQUIRED_COLUMNS).awaitTermination()
        return stream.current_snapshot(spark, target).head().plan_id

    assert load(5, 1) == "5"
    assert load(6, "many") == "5"
    assert load(4, 1) == "5"
    assert load(7, 2) == "7"
    findings = stream.findings(spark, target).collect()
    assert [(r.check, r.column, r.load_seq) for r in findings] == [("not numeric", "number_of_buses", 6)]


def test_csv_columns_go_by_name(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    write(folder / "a.csv", "plan_id,period,number_of_haj\np1,4,20\n")
    write(folder / "b.csv", "number_of_haj,plan_id,period\n30,p2,5\n")
    write(folder / "c.csv", '"ID","Period\n","Number of ""haj"""\np3,6,7\n')
    got = files.read_plans(spark, str(folder)).orderBy("_row").collect()
    assert [(r.plan_id, r.period, r.number_of_haj) for r in got][:2] == [("p1", "4", 20.0), ("p2", "5", 30.0)]
    assert [r._row >> 33 for r in got] == [0, 1, 2] and got[2].plan_id == "p3"
    cells = {r.file.rsplit("/", 1)[1]: r.cells for r in files.headers(spark, str(folder)).collect()}
    assert cells["c.csv"] == ["ID", "Period", 'Number of "haj"']
    missing = {(r.value, r.column) for r in files.header_report(spark, str(folder), ("period", "plan_id", "path_name")).collect()}
    assert missing == {(f, "path_name") for f in cells}


def test_header_of_many_lines(spark, tmp_path):
    folder = tmp_path / "long"
    folder.mkdir()
    note = '"' + "\n".join(f'line {i}, ""so""' for i in range(3000)) + '"'
    (folder / "a.csv").write_text(f'path_name,{note},"plan\n_id",period\nR1,x,"p\n1",2\n')
    (folder / "b.csv").write_text('period,plan_id,path_name\n3,"p\n2",R2\n')
    (folder / "c.csv").write_text('period,"plan_id\n3,p2\n')  # never closed
    cells = {r.file.rsplit("/", 1)[1]: r.cells for r in files.headers(spark, str(folder)).collect()}
    assert [c[:12] for c in cells["a.csv"]] == ["path_name", 'line 0, "so"', "plan _id", "period"] and cells["a.csv"][1].endswith('line 2999, "so"')
    assert cells["b.csv"] == ["period", "plan_id", "path_name"] and cells["c.csv"][0] == "period"
    missing = {(r.value, r.column) for r in files.header_report(spark, str(folder), ("period", "path_name")).collect()}
    assert missing == {("c.csv", "path_name")}


def test_stream_reads_by_name_and_reports_unnumbered_files(spark, tmp_path):
    folder, target = tmp_path / "arrivals", str(tmp_path / "plans")
    folder.mkdir()
    columns = list(reversed(s.REQUIRED_COLUMNS))
    write(folder / "plans_3.csv", plan_csv(columns, plan_id="P9", camp_label="1/608"))
    write(folder / "plans.csv", plan_csv(plan_id="unnumbered"))
    write(folder / "plans_4.csv", plan_csv([c for c in columns if c != "period"], plan_id="P10"))
    write(folder / "plans_5.csv", plan_csv(plan_id="P11").rstrip("\n") + ",one more\n")
    stream.start_ingest(stream.read_plan_stream(spark, str(folder)), target, str(tmp_path / "cp"), s.REQUIRED_COLUMNS).awaitTermination()
    row = stream.current_snapshot(spark, target).head()
    assert (row.plan_id, row.camp_label, row.load_seq) == ("P9", "1/608", 3)
    found = {(r.check, r.column, r.load_seq) for r in stream.findings(spark, target).collect()}
    assert found == {("no load number", None, None), ("missing column", "period", 4), ("row width", None, 5)}


def test_publish_from_the_current_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    sink.publish(spark.range(3), path, "a")
    sink.publish(sink.current(spark, path).select("id").where("id > 0"), path, "b")
    assert sorted((r.id, r.source_file) for r in sink.current(spark, path).collect()) == [(1, "b"), (2, "b")]
    sink.clear(spark.range(3), path)
    assert sink.current(spark, path).count() == 0


def test_natural_order_of_long_numbers(spark):
    from pyspark.sql import functions as F

    from convoyspark.functions import text as t

    values = ["7", "a2", "a10", "1" * 25, "a02b", "007x", "", "x", "9" * 19]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v string").orderBy(t.natural_key(F.col("v")), "v").collect()]
    assert got == ["", "7", "007x", "9" * 19, "1" * 25, "a2", "a02b", "a10", "x"]


def test_unrecorded_versions_are_not_read(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        sink.current(spark, path)
    sink.publish(spark.range(3), path, "a")
    spark.range(9).write.parquet(f"{path}/version=9999-unfinished")  # a writer that died before it recorded its version
    assert sink.current(spark, path).count() == 3 and sink.current(spark, path).head().source_file == "a"
    sink.publish(sink.current(spark, path).select("id").limit(1), path, "b")
    assert sink.current(spark, path).count() == 1
    sink.clear(spark.range(1), path)
    assert sink.current(spark, path).count() == 0


def test_unrecorded_loads_are_written_again(spark, tmp_path):
    target = str(tmp_path / "plans")
    spark.range(1).write.parquet(f"{target}/load_seq=7")  # half a publication
    folder = tmp_path / "arrivals"
    folder.mkdir()
    for seq in (7, 3):
        write(folder / f"plans_{seq}.csv", plan_csv(plan_id=f"p{seq}", number_of_buses=1))
    stream.start_ingest(stream.read_plan_stream(spark, str(folder)), target, str(tmp_path / "cp"), s.REQUIRED_COLUMNS).awaitTermination()
    assert [r.plan_id for r in stream.current_snapshot(spark, target).collect()] == ["p7"]


def test_features_of_several_files(spark, tmp_path):
    feature = '{"properties":{"Name":"%s"},"geometry":{"type":"Point","coordinates":[%d,2]}}'
    for name, ids in (("b", "cd"), ("a", "xyz"), ("c", "")):
        body = ",\n".join(feature % (x, i) for i, x in enumerate(ids))
        write(tmp_path / f"{name}.geojson", '{"type":"FeatureCollection","features":[' + body + "]}")
    rows = files.districts(files.read_features(spark, str(tmp_path))).orderBy(s.ROW).collect()
    assert [r.district_name for r in rows] == ["x", "y", "z", "c", "d"] and len({r[s.ROW] for r in rows}) == 5
    assert [r[s.ROW] for r in rows][:4] == [0, 1, 2, 1 << 33]


def test_collections_are_cut_into_blocks_in_the_order_of_rows(spark, tmp_path):
    """A collection is read by one task, so rows far apart must not share a file; their order stays."""
    import __spark_entry__ as entry

    rows = [4, 8, 200_000, 1 << 40, -4, 1, 65_537, None]
    df = spark.createDataFrame([(r, f"c{r}") for r in rows], f"{s.ROW} bigint, code string").withColumn("shape", F.array(F.lit(1.0), F.lit(2.0)))
    path = entry._collections(df, str(tmp_path / "layers"), {"code": F.col("code")}, "Point", 4)
    read = files.read_features(spark, f"{path}/part=*/block=*")
    assert [r.code for r in read.orderBy(s.ROW).select(F.col("properties")["code"].alias("code")).collect()] == [
        "c-4", "c4", "c8", "c200000", f"c{1 << 40}", "c1", "c65537", "cNone"]
    assert len(list((tmp_path / "layers").glob("part=0/block=*"))) == 4


def test_headers_are_reported_from_compressed_files(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    def few_plans(spark, sf, *columns):
        return spark.range(50).select(*[F.concat(F.lit('{"x":"'), F.col("id").cast("string"), F.lit('"}')).alias(c) for c in columns])

    monkeypatch.setattr(entry, "_plans", few_plans)
    monkeypatch.setattr(entry, "_folder", lambda spark, name: str(tmp_path / name))
    missing = {r["column"] for r in entry.queries()["dq_missing_columns"](spark, "").collect()}
    assert missing == {"path_name", "timing_start_at_hijri", "timing_end_at_hijri"}
    written = list((tmp_path / "headers").glob("part-*"))
    assert written and all(f.name.endswith(".csv.gz") for f in written)
