"""The belief fold on a stream against the batch fold, row by row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairnlight.operators import beliefs as B
from cairnlight.streaming import folds

SCHEMA = "belief long, ts timestamp, seq long, direction string, strength string, source string, override boolean"
KINDS, POWERS, SOURCES = ("support", "challenge", "neutral", "support"), ("weak", "moderate", "strong", "decisive", "odd"), ("paper", "experiment", "report", "who")


def evidence(n):
    start = dt.datetime(2024, 1, 1)
    return [(i % 7, start + dt.timedelta(minutes=i * 7 % 5000, seconds=i % 3), i, KINDS[i % 4], POWERS[i * 3 % 5], SOURCES[i * 5 % 4], i % 29 == 0) for i in range(n)]


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_batch(spark, tmp_path, files):
    rows = sorted(evidence(700), key=lambda r: r[1])
    cut = [rows[i * len(rows) // files : (i + 1) * len(rows) // files] for i in range(files)]
    for a, b in zip(cut, cut[1:]):  # neighbours in time arrive in the wrong file, within the hour
        a[-3:], b[:3] = b[:3], a[-3:]
    final = (dt.datetime(2030, 1, 1), 7)  # a last row moves the watermark past the others
    for i, part in enumerate([*cut, [(99, final[0], 0, "support", "weak", "paper", False)]]):
        spark.createDataFrame(part[::-1], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    beliefs = spark.createDataFrame([(i, 0.5 + i / 40, 0.1 * i, i) for i in range(8)] + [(99, 0.5, 0.0, 0)], "belief long, confidence double, entrenchment double, dependencies int")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got: dict = {}

    def keep(df, _):
        for r in df.collect():
            if r.belief not in got or r.n_steps >= got[r.belief].n_steps:
                got[r.belief] = r

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        q = folds.folded(stream, beliefs).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    order = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    batch = spark.createDataFrame([(r[0], order[r[2]], *r[3:]) for r in rows], "belief long, seq long, direction string, strength string, source string, override boolean")
    for fold in (B.fold, B.fold_long):
        want = {r.belief: r for r in fold(batch, beliefs).filter(F.col("belief") < 7).collect()}
        assert {k: (r.confidence, r.entrenchment, r.n_support, r.n_challenge, r.n_steps) for k, r in got.items() if k < 7} == {k: (r.confidence, r.entrenchment, r.n_support, r.n_challenge, r.n_steps) for k, r in want.items()}
    assert 7 not in got and 99 not in got  # no evidence; evidence that still waits
