"""Gap segments of a stream of packets: session windows over event time, and a stateful pass that gives the batch job's rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SEGMENT = "segment long, packet_start long, packet_end long, words long, phase long, span_ms long, closed string"
STATE = "last_order long, last_ms long, last_ts_ms long, taken long, segment long, packet_start long, start_ms long, words long, phase long, timer long"
EDGES = "words array<long>"


def streaming_segments(events: DataFrame, gap: str = "1 day", late: str = "2 days") -> DataFrame:
    """session, start, end, n for events (ts, session): a segment ends when ``gap`` passes without a packet; packets later
    than ``late`` are left out, as the watermark says. The adaptive threshold needs a whole session and stays a batch job."""
    return events.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _Segments(StatefulProcessor):
    """One session's packets in the order of ``arrival``, whatever micro-batches they come in."""

    def __init__(self, gap_ms: float, idle_ms: int, channels: int):
        self.gap_ms, self.idle_ms, self.channels = gap_ms, idle_ms, channels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", STATE)
        self.edges = handle.getValueState("edges", EDGES)

    def _closed(self, key, s: dict, by: str) -> dict:
        return {"session": key[0], "segment": s["segment"], "packet_start": s["packet_start"], "packet_end": s["taken"], "words": s["words"], "phase": s["phase"], "span_ms": s["last_ms"] - s["start_ms"], "closed": by}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packets = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        s = dict(zip([f.split()[0] for f in STATE.split(", ")], self.seen.get(), strict=True)) if self.seen.exists() else None
        edges = list(self.edges.get()[0]) if s else [None] * self.channels
        out: list[dict] = []
        for arrival, ms, ts, payload in packets[["arrival", "received_ms", "ts", "payload"]].itertuples(index=False, name=None):
            ms, at, payload = int(ms), int(ts.timestamp() * 1000), np.asarray([] if payload is None else payload)
            if s is None:
                s = dict.fromkeys([f.split()[0] for f in STATE.split(", ")], 0) | {"last_order": -1, "timer": -1}
                s |= {"start_ms": ms, "last_ms": ms, "last_ts_ms": at}
            elif arrival <= s["last_order"]:
                continue  # a replay, or a straggler: what came after it was judged without it
            elif s["packet_start"] < s["taken"] and (ms < s["last_ms"] or ms - s["last_ms"] > self.gap_ms):
                out.append(self._closed(key, s, "regression" if ms < s["last_ms"] else "gap"))
                s |= {"segment": s["segment"] + 1, "packet_start": s["taken"], "start_ms": ms, "words": 0}
            elif s["packet_start"] == s["taken"]:  # the segment before was closed by a timer
                s |= {"start_ms": ms}
            for k in range(min(self.channels, len(payload))):
                last = (len(payload) - 1 - k) // self.channels * self.channels + k
                edges[(s["phase"] + k) % self.channels] = int(payload[last])
            s |= {"last_order": int(arrival), "last_ms": ms, "last_ts_ms": max(s["last_ts_ms"], at), "taken": s["taken"] + 1, "words": s["words"] + len(payload), "phase": s["phase"] + len(payload)}
        if s:
            if s["timer"] >= 0:
                self.handle.deleteTimer(s["timer"])
            s["timer"] = s["last_ts_ms"] + self.idle_ms
            self.handle.registerTimer(s["timer"])
            self.seen.update(tuple(s.values()))
            self.edges.update((edges,))
        yield pd.DataFrame(out, columns=["session", *[f.split()[0] for f in SEGMENT.split(", ")]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        if self.seen.exists():
            s = dict(zip([f.split()[0] for f in STATE.split(", ")], self.seen.get(), strict=True))
            if s["packet_start"] < s["taken"]:
                out.append(self._closed(key, s, "idle"))
            s |= {"segment": s["segment"] + 1, "packet_start": s["taken"], "words": 0, "timer": -1}
            self.seen.update(tuple(s.values()))
        yield pd.DataFrame(out, columns=["session", *[f.split()[0] for f in SEGMENT.split(", ")]])

    def close(self) -> None:
        pass


def stateful_segments(packets: DataFrame, gap_ms: float = 1500.0, idle: str = "1 hour", late: str = "10 minutes", channels: int = 1) -> DataFrame:
    """session, segment, packet_start, packet_end (exclusive), words, phase, span_ms, closed: the rows that
    ``timebase.segment_ranges`` gives for a fixed threshold, in any split of the stream into micro-batches.

    ``packets``: session, arrival (a number that grows along the session), ts (event time), received_ms, payload. State a
    session: its last time and arrival, packets taken, the open segment, ``phase`` (words so far, where a continuous layout
    goes on) and the last word of each of ``channels``; it doesn't grow with the session. A segment comes out when time
    goes back or a gap passes ``gap_ms`` (``closed``: regression, gap), or once the watermark, ``late`` behind the
    latest event time, has passed its last packet by ``idle`` (idle); ``idle`` should be longer than the gap.

    Late data: a packet whose arrival isn't after the last one taken is left out, so replays change nothing; so are
    packets whose ts the watermark has passed. Null payloads have no words. Needs the RocksDB state store.
    """
    columns = packets.select("session", "arrival", "ts", "received_ms", "payload").withWatermark("ts", late)
    kind = packets.schema["session"].dataType.simpleString()
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return columns.groupBy("session").transformWithStateInPandas(_Segments(gap_ms, idle_ms, channels), f"session {kind}, {SEGMENT}", "Append", "EventTime")
