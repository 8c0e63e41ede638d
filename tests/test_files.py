"""Readers, writers, incremental processing and whole runs."""

import datetime as dt
import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewright.operators import forecast, profile
from tablewright.plans import runs
from tablewright.sources import files, sinks, tables, text
from tablewright.streaming import ledger, watch


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content) if isinstance(content, str) else path.write_bytes(content)
    return str(path)


def test_csv_types_and_null_spellings(spark, tmp_path):
    content = (
        "id,v,d,flag,name,empty,big,sci,when\n"
        "1,1.5,NA,true,a ,,99999999999999999999,1e3,2024-01-01\n"
        "2,N/A,x,False, b,null,1,-.5,2024-01-02\n"
        '3 ,,null,TRUE,"c, ""q""\nline two",NaN,2,inf,\n'
    )
    df = files.load(spark, put(tmp_path / "t.csv", content))
    assert dict(df.dtypes) == {
        "id": "bigint", "v": "double", "d": "string", "flag": "boolean", "name": "string", "empty": "double",
        "big": "double", "sci": "double", "when": "string",
    }
    rows = df.orderBy("id").collect()
    assert [r["v"] for r in rows] == [1.5, None, None]
    assert [r["d"] for r in rows] == [None, "x", None]
    assert [r["flag"] for r in rows] == [True, False, True]
    assert [r["name"] for r in rows] == ["a ", " b", 'c, "q"\nline two']
    assert rows[2]["sci"] == float("inf") and rows[0]["big"] == 1e20


def test_csv_repeated_headers_and_integers_with_gaps(spark, tmp_path):
    df = files.load(spark, put(tmp_path / "r.csv", "a,a,,a.1\n1,2,3,4\n5,,7,8\n"))
    assert df.columns == ["a", "a.1", "Unnamed: 2", "a.1.1"]
    assert df.dtypes[1][1] == "bigint"
    assert text.distinct_names(["x", "x", "x"]) == ["x", "x.1", "x.2"]


@pytest.mark.parametrize("content", ["", "a,b\n"])
def test_empty_files_are_errors(spark, tmp_path, content):
    path = put(tmp_path / "e.csv", content)
    with pytest.raises(files.IngestError):
        files.load(spark, path)


def test_missing_and_unsupported_files(spark, tmp_path):
    for name in ("none.csv", "none.parquet", "none.json", "none.xlsx", "x.txt", "x.xls", "noext"):
        with pytest.raises(files.IngestError):
            files.load(spark, str(tmp_path / name))


def test_json_lists_only(spark, tmp_path):
    good = put(tmp_path / "g.json", '\n [{"a": 1, "b": "x", "c": {"d": 2}},\n {"a": 2.5, "b": null}]')
    df = files.load(spark, good)
    assert df.count() == 2 and dict(df.dtypes)["c"] == "struct<d:bigint>" and dict(df.dtypes)["a"] == "double"
    with pytest.raises(files.IngestError):
        files.load(spark, put(tmp_path / "o.json", '{"a": 1}'))


def test_parquet_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(path)
    assert files.load(spark, path).where("x IS NULL").count() == 1


def workbook(path, sheet, shared=(), styles=True):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId7" Type="w" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        )
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return str(path)


def test_excel(spark, tmp_path):
    head = "".join(f'<c r="{c}1" t="s"><v>{i}</v></c>' for i, c in enumerate("ABCDEF"))
    body = (
        '<row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>1.5</v></c><c r="C2" t="s"><v>6</v></c><c r="D2" s="1"><v>45292</v></c>'
        '<c r="E2" t="b"><v>1</v></c><c r="F2" t="inlineStr"><is><t>7</t></is></c></row>'
        '<row r="3"/>'
        '<row r="4"><c r="A4"><v>2</v></c><c r="D4" s="2"><v>45292.75</v></c><c r="E4" t="b"><v>0</v></c><c r="F4"><v>8</v></c></row>'
    )
    names = ["id", "v", "name", "day", "ok", "mixed", "ann"]
    path = workbook(tmp_path / "b.xlsx", f'<row r="1">{head}</row>{body}', names)
    df = files.load(spark, path)
    assert dict(df.dtypes) == {
        "id": "bigint", "v": "double", "name": "string", "day": "timestamp_ntz", "ok": "boolean", "mixed": "string",
    }
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [
        (1, 1.5, "ann", dt.datetime(2024, 1, 1), True, "7"),
        (2, None, None, dt.datetime(2024, 1, 1, 18), False, "8"),
    ]


def test_listing(spark, tmp_path):
    for name in ("a.CSV", "b.txt", "c.json", "noext"):
        put(tmp_path / "in" / name, "x")
    rows = {r["path"].rsplit("/", 1)[1]: (r["file_type"], r["supported"], r["length"]) for r in files.list_files(spark, str(tmp_path / "in")).collect()}
    assert rows == {"a.CSV": (".csv", True, 1), "b.txt": (".txt", False, 1), "c.json": (".json", True, 1)}
    size = files.size_of(spark, str(tmp_path / "in" / "c.json"))
    assert profile.summary(spark.range(3), "/in/c.json", size).first()["file_size_kb"] == 0.0
    assert spark.range(1).select(size).first()[0] == 1
    df = spark.createDataFrame([("/x/a.b/.hidden",), ("/x/y.tar.gz",), ("z.CSV",)], "p string")
    assert [tuple(r) for r in df.select(files.file_type(F.col("p")), files.base_name(F.col("p"))).collect()] == [
        ("", ".hidden"), (".gz", "y.tar"), (".csv", "z"),
    ]


def test_tables_and_sql(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, k string")
    sinks.write_table(df, "tw_test", "replace")
    sinks.write_table(df, "tw_test", "append")
    assert tables.load_table(spark, "tw_test").count() == 6
    assert files.load(spark, "table:tw_test", limit=4).count() == 4
    assert tables.query(spark, "SELECT k, count(*) AS n FROM {t} WHERE id > 1 GROUP BY k", t=df).collect()[0]["n"] == 2
    assert tables.execute(spark, "DROP TABLE tw_test").collect() == []
    with pytest.raises(ValueError):
        sinks.write_table(df, "tw_test", "sideways")
    with pytest.raises(ValueError):
        tables.load_jdbc(spark, "jdbc:none")


def test_sinks(spark, tmp_path):
    assert sinks.processed_path("/out/", "/in/a.b.csv") == "/out/a.b_processed"
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, k string")
    for _ in range(2):
        out = sinks.write_files(df, str(tmp_path / "o"), "csv")
    assert sorted(tuple(r) for r in spark.read.csv(out, header=True).collect()) == [("1", "a"), ("2", None)]
    use_cases = F.array(F.struct(*[F.lit(v).alias(n) for n, v in (("title", "T"), ("description", "D"), ("impact", "High"), ("effort", "Low"))]))
    doc = sinks.insights_document(df, "a.csv", F.create_map(F.lit("general"), F.lit("text")), use_cases)
    path = sinks.write_files(doc, str(tmp_path / "j"), "json")
    name = next(f for f in os.listdir(path) if f.endswith(".json"))
    got = json.loads(open(os.path.join(path, name)).read())
    assert got["insights"] == {"general": "text"} and got["use_cases"][0]["impact"] == "High"
    assert got["data_summary"]["rows"] == 2 and got["data_summary"]["missing_values"] == {"id": 0, "k": 1}
    assert len(got["data_summary"]["generation_time"]) == 19


def test_forecast_documents(spark):
    rows = [(k, dt.date(2024, 1, d + 1), float(d)) for k in "ab" for d in range(6)] + [("short", dt.date(2024, 1, 1), 1.0)]
    ahead = forecast.forecast_sma(spark.createDataFrame(rows, "k string, d date, v double"), "d", "v", 3, by=["k"])
    docs = {r["k"]: r for r in sinks.forecast_documents(ahead, ["k"]).collect()}
    assert docs["a"]["forecast"]["dates"] == ["2024-01-07 00:00:00", "2024-01-08 00:00:00", "2024-01-09 00:00:00"]
    assert docs["a"]["forecast"]["values"] == [3.0] * 3 and docs["a"]["model_params"]["window_size"] == 5
    assert docs["short"]["error"] and docs["short"]["forecast"]["values"] == []


def test_batch_handles_new_files_once_and_goes_on_after_a_failure(spark, tmp_path):
    source, out, book = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ledger")
    put(source / "good.csv", "id,v\n1,2\n2,\n2,\n")
    put(source / "bad.csv", "a,b\n")
    put(source / "skip.txt", "x")
    work = runs.file_worker(spark, out)
    first = watch.run_batch(spark, str(source), book, work)
    assert ledger.batch_summary(first).first().asDict() == {"total": 2, "successes": 1, "failures": 1}
    lines = {r["file"]: (r["status"], r["details"]) for r in ledger.file_results(first).collect()}
    assert lines["good.csv"] == ("success", "Processed successfully") and "No rows" in lines["bad.csv"][1]
    cleaned = spark.read.csv(f"{out}/good_processed", header=True)
    assert sorted(r["v"] for r in cleaned.collect()) == ["2.0", "2.0"]
    note = spark.read.json(f"{out}/good_insights").first()
    assert note["file_name"] == "good.csv" and "DataFrame shape: 2 rows" in note["insights"]["data_description"]
    put(source / "bad.csv", "a,b\n1,2\n")
    put(source / "more.json", '[{"a": 1}]')
    second = watch.run_batch(spark, str(source), book, work)
    assert sorted(r["base_name"] for r in second.collect()) == ["bad", "more"]
    assert watch.run_batch(spark, str(source), book, work).count() == 0


def test_stream_sees_each_new_file_once_across_a_restart(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    old = put(source / "old.csv", "a\n1\n")
    os.utime(old, (time.time() - 3600, time.time() - 3600))
    seen = []

    def on_file(path):
        seen.append(path.rsplit("/", 1)[1])
        if "bad" in path:
            raise RuntimeError("cannot read this one")
        return {"output_path": "x"}

    start = dt.datetime.now() - dt.timedelta(minutes=1)
    put(source / "new.csv", "a\n2\n")
    put(source / "bad.json", "[]")
    put(source / "other.log", "zzz")
    watch.watch(spark, str(source), state, on_file, start=start, poll_seconds=None).awaitTermination()
    put(source / "late.csv", "a\n3\n")
    for _ in range(2):
        watch.watch(spark, str(source), state, on_file, poll_seconds=None).awaitTermination()
    assert sorted(seen) == ["bad.json", "late.csv", "new.csv"]
    got = {r["base_name"]: (r["status"], r["message"]) for r in ledger.read_ledger(spark, f"{state}/ledger").collect()}
    assert got == {"new": ("success", None), "late": ("success", None), "bad": ("error", "cannot read this one")}


def test_stream_goes_by_path_and_not_by_time(spark, tmp_path):
    source, state, seen = tmp_path / "in", str(tmp_path / "state"), []

    def on_file(path):
        seen.append(path.rsplit("/", 1)[1])

    def look():
        watch.watch(spark, str(source), state, on_file, poll_seconds=None).awaitTermination()

    there = put(source / "there.csv", "a\n1\n")
    os.utime(there, (time.time() + 3600, time.time() + 3600))
    look()
    assert seen == []
    for name, days in (("unpacked.csv", 30), ("copied.csv", 1)):
        os.utime(put(source / name, "a\n2\n"), (time.time() - days * 86400,) * 2)
    look()
    look()
    assert sorted(seen) == ["copied.csv", "unpacked.csv"]


def test_run_modes(spark):
    rows = [(i, ["x", "y"][i % 2], float(i % 7) if i % 5 else None, dt.date(2024, 1, 1) + dt.timedelta(days=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, k string, v double, d date")
    options = runs.Options(strategy="median", normalize=["v"], one_hot=["k"], measure="v", dimension="k", date="d", target="v", periods=4)
    full = runs.run(df, "full", runs.Options(measure="v", dimension="k", date="d", target="v", periods=4))
    assert {"validation", "processed", "cleaning_report", "summary", "describe", "histogram", "measure_by", "forecast", "forecast_chart"} <= set(full)
    for name, table in full.items():
        assert table.count() > 0, name
    only = runs.run(df, "process_only", options)
    assert set(only) == {"validation", "processed", "cleaning_report"}
    assert only["processed"].columns == ["id", "v", "d", "k_x", "k_y"]
    assert set(runs.run(df, "forecast_only", options)) == {"validation", "forecast", "forecast_chart"}
    assert "forecast" not in runs.run(df, "insights_only", options)
    with pytest.raises(ValueError):
        runs.run(df, "sideways")


def test_run_does_nothing_before_it_is_asked(spark):
    rows = [(i, ["x", "y"][i % 2], float(i % 7) if i % 5 else None, dt.date(2024, 1, 1) + dt.timedelta(days=i), None) for i in range(60)]
    df = spark.createDataFrame(rows, "`a b` int, k string, v double, d date, `odd,;{}()=` void")
    context = spark.sparkContext
    context.setJobGroup("lazy run", "")
    try:
        options = runs.Options(strategy="median", measure="v", dimension="k", date="d", target="v", periods=4)
        for mode in runs.MODES:
            assert runs.run(df, mode, options)
        assert not context.statusTracker().getJobIdsForGroup("lazy run")
        results = runs.run(df.drop("odd,;{}()="), "full", options)
        assert results["group_share"].count() == 2 and results["processed"] is results["processed"]
        # What is read is the table that was written, once.
        assert results["measure_by"].inputFiles() and set(results["measure_by"].inputFiles()) <= set(results["processed"].inputFiles())
        assert runs.run(df, "full", options)["summary"].first()["rows"] == 60
    finally:
        context._jsc.clearJobGroup()


def test_file_worker_describes_the_processed_table(spark, tmp_path):
    source = tmp_path / "t.csv"
    source.write_text("a,b\n1,x\n1,x\n,y\n")
    runs.file_worker(spark, str(tmp_path / "out"), fmt="parquet")(str(source))
    document = spark.read.json(str(tmp_path / "out" / "t_insights")).first()
    assert document["data_summary"]["rows"] == 2 and document["data_summary"]["missing_values"]["a"] == 0
    assert "2 rows" in document["insights"]["data_description"]


def test_ledger_stays_small_and_survives_a_cut(spark, tmp_path):
    book = str(tmp_path / "book")
    for i in range(40):
        ledger.append_results(spark, book, [{"file_path": f"/in/f{i}.csv", "status": "success"}])
    assert len(os.listdir(book)) <= 2 + 8 + ledger.FAN_IN  # merged ones, single ones, replaced ones
    names = [r["base_name"] for r in ledger.read_ledger(spark, book).collect()]
    assert sorted(names) == sorted(f"f{i}" for i in range(40))
    # A segment that was cut short, and a merge that was: neither counts, and the next call puts its own in their place.
    for cut in ("results-000000000040-000000000040", "results-000000000000-000000000255"):
        os.mkdir(f"{book}/{cut}")
        (tmp_path / "book" / cut / "part-0.parquet").write_bytes(b"half")
    assert ledger.read_ledger(spark, book).count() == 40
    ledger.append_results(spark, book, [{"file_path": "/in/last.csv", "status": "error", "message": "no"}])
    assert ledger.read_ledger(spark, book).count() == 41
    assert ledger.read_ledger(spark, str(tmp_path / "none")).count() == 0
    put(tmp_path / "other" / "x.txt", "x")
    with pytest.raises(ledger.LedgerError):
        ledger.read_ledger(spark, str(tmp_path / "other"))


def test_an_undecoded_type_is_tried_once(spark, tmp_path):
    put(tmp_path / "in" / "old.xls", "not read")
    put(tmp_path / "in" / "new.csv", "a\n1\n")
    work = runs.file_worker(spark, str(tmp_path / "out"))
    runs_ = [watch.run_batch(spark, str(tmp_path / "in"), str(tmp_path / "book"), work).collect() for _ in range(2)]
    assert {(r["base_name"], r["status"]) for r in runs_[0]} == {("old", "error"), ("new", "success")}
    assert runs_[1] == []
