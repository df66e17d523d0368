"""Cases that real input brings: damaged rows, one class only, midnight, missing values."""

import json

import pytest
from pyspark.sql import functions as F

from tiescope import session
from tiescope.functions.binning import slots_of_day
from tiescope.ml import metrics
from tiescope.operators import features, graph, ordering, sampling
from tiescope.sources import readers


def test_damaged_rows_are_set_aside(spark, tmp_path):
    good = {"id": "1", "start_time": "2024-01-01T00:00:00Z", "end_time": "2024-01-01T01:00:00Z", "timestamp_seen": 5}
    lines = [json.dumps(good), json.dumps(good | {"start_time": "soon"}), "{not json"]
    (tmp_path / "rows.json").write_text("\n".join(lines))
    read = readers.read_locations(spark, str(tmp_path), "jsonl")
    assert readers.rejected(read).count() == 2
    times = readers.with_instants(read).filter("start_time is not null").collect()
    assert [r.id for r in times] == ["1"] and times[0].seen_at is not None


def test_csv_keeps_devices(spark, tmp_path):
    (tmp_path / "rows.csv").write_text('timestamp_seen,id,useruuid,start_time,end_time,name,area,country,region,latitude,'
                                       'longitude,altitude,accuracy,datum,devices\n'
                                       '1,a,u,,,,,,,1.5,2.5,1,2,W,"[{""name"": ""n"", ""type"": ""t"", ""id"": ""7""}]"\n')
    row = readers.read_locations(spark, str(tmp_path), "csv").first()
    assert row.devices[0].id == "7" and row.latitude == 1.5


def test_bad_birthdate(spark, tmp_path):
    (tmp_path / "people.csv").write_text("u1,MALE,1980-02-03\nu2,FEMALE,someday\n")
    rows = {r.useruuid: r.age for r in readers.read_demographics(spark, str(tmp_path), "2024-02-01").collect()}
    assert rows == {"u1": 44, "u2": None} or rows["u2"] is None and rows["u1"] in (43, 44)


def test_slots_over_midnight(spark):
    df = spark.sql("select timestamp'2024-01-01 23:50:00' as a, timestamp'2024-01-02 00:10:00' as b")
    assert df.select(slots_of_day(F.col("a"), F.col("b"), 15)).first()[0] == [95, 0]
    assert df.select(slots_of_day(F.col("a"), F.col("b"), 15, ref_compat=True)).first()[0] == []


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.2, 0)], "label int, score double, prediction int")
    assert metrics.roc_auc(df).first()[0] is None
    assert metrics.average_precision(df).first()[0] == 1.0
    assert metrics.roc_at(df).count() >= 0 and metrics.roc_curve(df).count() == 2


def test_gender_flags(spark):
    rows = [(30, 31, None, None, True, True), (30, 31, "M", None, True, True), (None, 31, None, "M", None, True)]
    df = spark.createDataFrame(rows, "age1 int, age2 int, gender1 string, gender2 string, listed1 boolean, listed2 boolean")
    got = df.withColumns(features.similarity_columns()).select("gender_differs", "gender_same", "gender_unknown").collect()
    assert [tuple(r) for r in got] == [(0, 1, 0), (1, 0, 0), (0, 0, 1)]


@pytest.mark.parametrize("values", [range(1_700_000_000_000_000, 1_700_000_000_400_000, 100), [k / 1e7 for k in range(4000)]])
def test_even_slices(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v " + ("double" if isinstance(values, list) else "long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small slices would be put together
    try:
        sizes = [r["count"] for r in ordering.with_bucket(df, "v").groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) <= 4 * sum(sizes) / 8


def test_ratio_draw_repeats(spark):
    df = spark.createDataFrame([(k, k + 1, int(k % 5 == 0)) for k in range(3000)], "user1 long, user2 long, label int")
    first = sampling.undersample_ratio(df).collect()
    again = sampling.undersample_ratio(df.repartition(7)).collect()
    assert sorted(first) == sorted(again) and 400 < sum(r.label == 0 for r in first) < 800


def test_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default: None})()

    with pytest.raises(ValueError):
        session.shared_folder(Session())
    Context.master = "local[2]"
    assert session.shared_folder(Session()) == session.shared_folder(Session())
