import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators.gating import low_passed
from tensorloom.streaming.causal import causal_gate
from tensorloom.streaming.gates import gate_stream


def test_stream_equals_batch(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(day + dt.timedelta(hours=3 * i), float(i * 7 % 120)) for i in range(40)] + [(day, None)]
    df = spark.createDataFrame(rows, "ts timestamp, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = gate_stream(stream, "ts", "value", 100.0, 4).writeStream.outputMode("update").format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    want = {tuple(r) for r in gate_stream(df, "ts", "value", 100.0, 4).collect()}
    assert {tuple(r) for r in spark.sql("select * from gated").collect()} == want


def _series():
    rng = np.random.default_rng(0)
    day = dt.datetime(2024, 1, 1)
    return [(s, day + dt.timedelta(seconds=i), float(np.sin(i / 5) + i / 50 + rng.normal() / 10) if i != 17 else None) for s in ("a", "b") for i in range(60 if s == "a" else 25)]


def _values(rows):
    return {(r["k"], r["ts"]): tuple(None if x is None else round(float(x), 9) for x in (r["low"], r["mean"], r["above"], r["late"])) for r in rows}


def test_causal_gate_is_the_filter(spark):
    rows = _series()
    got = _values(causal_gate(spark.createDataFrame(rows, "k string, ts timestamp, v double").repartition(5), "k", "ts", "v", 0.05).collect())
    assert len(got) == len(rows)
    for s in ("a", "b"):
        own = [(t, v) for k, t, v in rows if k == s and v is not None]
        low = low_passed(np.concatenate([[v for _, v in own], np.zeros(4000)]), 0.05, causal=True)[: len(own)]
        rest = np.array([v for _, v in own]) - low
        mean = np.cumsum(rest) / np.arange(1, len(own) + 1)
        for i, (t, _) in enumerate(own):
            assert abs(got[s, t][0] - low[i]) < 1e-6 and abs(got[s, t][1] - mean[i]) < 1e-6 and got[s, t][2] == float(rest[i] >= mean[i]) and not got[s, t][3]
    assert causal_gate(spark.createDataFrame([], "k string, ts timestamp, v double"), "k", "ts", "v").count() == 0


@pytest.mark.parametrize("cuts", [(), (1, 20, 21), (40,)])
def test_causal_gate_of_any_split_equals_the_batch(spark, tmp_path, cuts):
    df = spark.createDataFrame(_series(), "k string, ts timestamp, v double")
    want = _values(causal_gate(df, "k", "ts", "v", 0.05).collect())
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    edges = [0, *cuts, 60]
    name = f"causal_{len(cuts)}"
    start = dt.datetime(2024, 1, 1)
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = df.where((F.col("ts") >= start + dt.timedelta(seconds=lo)) & (F.col("ts") < start + dt.timedelta(seconds=hi)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if lo == 0:
            query = causal_gate(stream, "k", "ts", "v", 0.05).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
    spark.createDataFrame([("a", start, 1e9)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    rows = spark.sql(f"select * from {name}").collect()
    assert _values([r for r in rows if r["v"] != 1e9]) == want
    (late,) = [r for r in rows if r["v"] == 1e9]
    assert late["late"] and late["low"] is None
