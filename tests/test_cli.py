import datetime as dt

from headway import cli
from headway.operators import maintenance as MT
from headway.sources import adapters as A

SF = "/root/testdata/sf0.001"


def test_report_backfill_reconcile_drops(spark, tmp_path, capsys):
    acc = str(tmp_path / "acc")
    MT.write_accuracy(A.prediction_accuracy_hist(spark, SF), acc)
    out = str(tmp_path / "csv")
    assert cli.main(["report", "--accuracy", acc, "--out", out, "--chart-range", "Daily",
                     "--date-start", "1996-01-01", "--date-end", "1996-02-01"]) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*.csv")))
    assert text.splitlines()[0] == "Daily,Prod Accuracy,Err,RMSE,Count"
    assert cli.main(["report", "--accuracy", acc, "--out", out, "--chart-range", "Daily"]) == 2
    assert "No start or end date given." in capsys.readouterr().out

    first = spark.read.parquet(acc).agg({"service_date": "min"}).first()[0]
    dest = str(tmp_path / "dest")
    assert cli.main(["backfill", "--source", acc, "--dest", dest, "--cursor", str(first), "--today", "2030-01-01"]) == 0
    copied = spark.read.parquet(dest)
    src = spark.read.parquet(acc)
    window = src.filter(src.service_date.between(first, first + dt.timedelta(days=6)))
    assert copied.count() == window.count() > 0
    assert copied.agg({"service_date": "max"}).first()[0] <= first + dt.timedelta(days=6)

    ca, cb = A.accuracy_copies(spark, SF)
    ca.write.parquet(str(tmp_path / "ca"))
    cb.write.parquet(str(tmp_path / "cb"))
    capsys.readouterr()
    assert cli.main(["reconcile", "--a", str(tmp_path / "ca"), "--b", str(tmp_path / "cb")]) == 0
    assert "monolithic" in capsys.readouterr().out
    assert cli.main(["drops", "--accuracy", acc, "--today", "1996-01-10"]) == 0


def test_report_by_station_with_names(spark, tmp_path):
    acc = str(tmp_path / "acc")
    MT.write_accuracy(A.prediction_accuracy_hist(spark, SF), acc)
    stops = str(tmp_path / "stops")
    spark.createDataFrame(
        [([("70061", ("Alewife - Red Line", "Alewife", None))], "subway")],
        "data array<struct<id string, attributes struct<description string, name string, platform_name string>>>, mode string",
    ).write.json(stops)
    out = str(tmp_path / "csv")
    assert cli.main(["report", "--accuracy", acc, "--out", out, "--chart-range", "By Station", "--stops", stops,
                     "--date-start", "1996-01-01", "--date-end", "1996-02-01"]) == 0
    lines = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*.csv"))).splitlines()
    assert lines[0] == "By Station,Prod Accuracy,Err,RMSE,Count"
    labels = {line.split(",")[0] for line in lines[1:]}
    assert "Alewife" in labels and "70063" in labels
