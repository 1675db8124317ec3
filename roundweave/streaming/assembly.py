"""Conversations put together from a stream of turns, each given out as soon as it is whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "conv_id long, state string, turns array<struct<turn:long,role:string,text:string>>"
#: States of what is given out.
WHOLE, BROKEN_OFF, LATE = "whole", "broken off", "late"
ENDS = r"(?s)<answer>.*?</answer>"


def marked(turns: DataFrame, time: str) -> DataFrame:
    """The columns that assembling needs; ``ends`` says whether a turn is a final answer, ``ms`` is the time."""
    ends = (F.col("role") == "assistant") & F.regexp_like("text", F.lit(ENDS))
    return turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.coalesce(ends, F.lit(False)).alias("ends"), F.unix_millis(time).alias("ms"), time)


class Assembly(StatefulProcessor):
    """The turns of one conversation that have come, until it is whole or the time is over."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn long", "role string, text string")
        # the turn of the final answer (-1: not come yet), the last time, and whether it was given out
        self.status = handle.getValueState("status", "ends long, ms long, given boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends, latest, given = self.status.get() if self.status.exists() else (-1, 0, False)
        late = []
        for batch in rows:
            for r in batch.itertuples(index=False):
                latest = max(latest, int(r.ms))
                if given:
                    late.append({"turn": r.turn, "role": r.role, "text": r.text})
                elif not self.turns.containsKey((r.turn,)):
                    self.turns.updateValue((r.turn,), (r.role, r.text))
                    if r.ends and (ends < 0 or r.turn < ends):
                        ends = int(r.turn)
        if not given and ends >= 0 and all(self.turns.containsKey((i,)) for i in range(ends + 1)):
            held = self._held()
            yield self._out(key, WHOLE, [t for t in held if 0 <= t["turn"] <= ends])
            late += [t for t in held if not 0 <= t["turn"] <= ends]
            self.turns.clear()
            given = True
        if late:
            yield self._out(key, LATE, sorted(late, key=lambda t: t["turn"]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(latest + self.gap_ms)
        self.status.update((ends, latest, given))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held:
            yield self._out(key, BROKEN_OFF, held)
        self.turns.clear()
        self.status.clear()

    def _held(self) -> list[dict]:
        return sorted(({"turn": k[0], "role": v[0], "text": v[1]} for k, v in self.turns.iterator()), key=lambda t: t["turn"])

    def _out(self, key: tuple, state: str, turns: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [key[0]], "state": [state], "turns": [turns]})

    def close(self) -> None:
        pass


def assembled(turns: DataFrame, time: str, delay: str, gap_ms: int) -> DataFrame:
    """``conv_id, state, turns`` out of a stream of turns.

    A conversation is ``whole``, and given out in the batch in which this comes true, when a turn with a final answer and all turns from 0 to it have come, in
    whatever order; a turn that comes twice counts once, the first stays. Turns behind the answer, and turns that come after it was given out, are
    given out as ``late``, so that nothing is lost. If nothing comes for ``gap_ms`` by the watermark, what there is is given out as
    ``broken off``, and all that is known of the conversation is dropped; turns that come still later begin it anew, unless they are behind the
    watermark by then. A null id or turn number takes no part. The session keeps its states in RocksDB from then on.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = marked(turns.withWatermark(time, delay), time)
    return rows.groupBy("conv_id").transformWithStateInPandas(Assembly(gap_ms), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def assembled_at_once(turns: DataFrame, time: str) -> DataFrame:
    """The same of all turns of a batch: ``whole`` conversations, with ``late`` and ``broken off`` turns beside them."""
    rows = marked(turns, time)
    listed = rows.groupBy("conv_id").agg(F.min(F.when(F.col("ends"), F.col("turn"))).alias("end"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    inside = F.filter("turns", lambda t: t["turn"].between(0, F.col("end")))
    whole = F.coalesce(F.size(inside) == F.col("end") + 1, F.lit(False))
    parts = F.when(whole, F.array(F.struct(F.lit(WHOLE).alias("state"), inside.alias("turns")), F.struct(F.lit(LATE).alias("state"), F.filter("turns", lambda t: ~t["turn"].between(0, F.col("end"))).alias("turns")))).otherwise(F.array(F.struct(F.lit(BROKEN_OFF).alias("state"), F.col("turns"))))
    return listed.select("conv_id", F.explode(parts).alias("p")).filter(F.size("p.turns") > 0).select("conv_id", "p.state", "p.turns")
