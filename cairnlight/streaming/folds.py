"""The belief fold on a stream, in the order of events: custom state with timers.

Evidence waits in the state of its belief until the watermark has passed it, so what arrives out of order is folded in
order, and what would come after its successors were folded is late and left out by the watermark. The fold is the batch
fold's own step: over the same evidence both give the same numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cairnlight.operators import beliefs as B

OUT = "belief {kind}, upto timestamp, confidence double, entrenchment double, n_support int, n_challenge int, n_steps int"
STATE, WAITING = "f string", "ts long, seq long, direction string, strength string, source string, override boolean"


class Folding(StatefulProcessor):
    """State: the running fold (with the belief's dependencies), and the evidence that waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = 0
        for b in rows:
            if not self.folded.exists():
                at = b.iloc[0]
                self.folded.update((json.dumps([*B.opened(float(at.confidence), float(at.entrenchment)), int(at.dependencies)]),))
            ts = b.ts.astype("int64") // (10**6 if str(b.ts.dtype).startswith("datetime64[ns") else 10**3)
            last = max(last, int(ts.max()))
            held = zip(ts.tolist(), b.seq.tolist(), b.direction.tolist(), b.strength.tolist(), b.source.tolist(), b.override.tolist(), strict=True)
            self.waiting.appendList([(int(t), int(s), *more) for t, s, *more in held])
        self.handle.registerTimer(last)  # one a batch and belief: evidence waits a little longer than it must
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] <= upto]
        if not due:
            return
        *s, dependencies = json.loads(self.folded.get()[0])
        for _, _, direction, strength, source, override in due:
            B.revise(s, direction, strength, source, bool(override), dependencies)
        self.folded.update((json.dumps([*s, dependencies]),))
        rest = rows[len(due):]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame([(key[0], pd.Timestamp(due[-1][0], unit="ms"), *s[:4], s[5])], columns=["belief", "upto", "confidence", "entrenchment", "n_support", "n_challenge", "n_steps"])

    def close(self) -> None:
        pass


def folded(evidence: DataFrame, beliefs: DataFrame, late: str = "1 hour") -> DataFrame:
    """belief, upto (the last evidence folded), confidence, entrenchment and counts, a row whenever a belief moved on.

    ``evidence`` (a stream): belief, ts, seq, direction, strength, source, override; ``beliefs`` (a table): belief,
    confidence, entrenchment, dependencies. Order is by ts, then seq. Evidence of an unknown belief, or without a time, is
    left out; evidence later than ``late`` is dropped. State grows with the beliefs and with what waits.
    """
    evidence.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = evidence.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts IS NOT NULL").withWatermark("ts", late)
    rows = timed.join(beliefs, "belief").select("belief", "ts", "seq", "direction", "strength", "source", "override", F.col("confidence").cast("double").alias("confidence"), F.col("entrenchment").cast("double").alias("entrenchment"), "dependencies")
    kind = rows.schema["belief"].dataType.simpleString()
    return rows.groupBy("belief").transformWithStateInPandas(Folding(), OUT.format(kind=kind), "Update", "EventTime")
