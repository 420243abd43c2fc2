"""An edit log as a stream: settled in order of seq per document, folded into state per node.

Edits of a document have the numbers 1, 2, 3 and so on, and may come late, out
of order or repeatedly. What has all its predecessors is settled: composed into
the summary of its node, which is what a batch fold (operators.edits.folded)
gives for the same log. What hasn't waits in state. A timer gives a gap up after
some patience; edits that come later still are told as late and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from paperloom.operators.edits import SUMMARY

_DID = SUMMARY.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
_SET = "align string, list string, src string, alt string"
#: A row for each node that changed (kind state, seq being what the document is settled to) or edit that came too late (kind late).
FOLDED = f"doc_id string, node_id string, seq long, kind string, {_DID}, {_SET}, op string, value string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOTHING = (False, 0, None, False, None, 0, None)
KEPT = ("align", "list", "src", "alt")


def number(value: str | None) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def summary_of(op: str, value: str | None) -> tuple:
    """As operators.edits.summary_of."""
    emptied, told = op == "text" and not value, op == "text" and bool(value)
    return emptied, int(op == "bold"), number(value) if op == "size" else None, told, value if told else None, 0, None


def then(a: tuple, b: tuple) -> tuple:
    """As operators.edits.then."""
    first = lambda *x: next((v for v in x if v is not None), None)
    if b[0]:
        return b
    if a[0] and not a[3]:
        return (True, 0, None, True, b[4], b[5], b[6]) if b[3] else a
    if a[3]:
        return a[0], a[1], a[2], True, first(b[4], a[4]), (a[5] + b[1] + b[5]) % 2, first(b[6], b[2], a[6])
    flips = a[1] + b[1]
    return False, flips and 2 - flips % 2, first(b[2], a[2]), b[3], b[4], b[5], b[6]


class Settler(StatefulProcessor):
    """State of a document: how far it is settled, edits that wait by seq, gaps that were given up, and a summary with the last set values by node."""

    def __init__(self, patience_ms: int | None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "seq long")
        self.waiting = handle.getMapState("waiting", "seq long", "op string, node_id string, value string")
        self.missed = handle.getMapState("missed", "seq long", "upto long")
        self.nodes = handle.getMapState("nodes", "node_id string", f"{_DID}, {_SET}")

    def settle(self, doc: str, skip: bool) -> list[tuple]:
        """Takes what waits and is next; with skip the first gap is given up."""
        done = self.done.get()[0] if self.done.exists() else 0
        if skip:
            next_one = min((k[0] for k in self.waiting.keys()), default=done + 1)
            if next_one > done + 1:
                self.missed.updateValue((done + 1,), (next_one - 1,))
                done = next_one - 1
        touched = {}
        while self.waiting.containsKey((done + 1,)):
            done += 1
            op, node, value = self.waiting.getValue((done,))
            self.waiting.removeKey((done,))
            if node is None or op is None:
                continue
            if node not in touched:
                touched[node] = tuple(self.nodes.getValue((node,))) if self.nodes.containsKey((node,)) else (*NOTHING, None, None, None, None)
            now = touched[node]
            kept = [value if op == k and value is not None else v for k, v in zip(KEPT, now[7:])]
            touched[node] = (*then(now[:7], summary_of(op, value)), *kept)
        self.done.update((done,))
        for node, state in touched.items():
            self.nodes.updateValue((node,), state)
        return [(doc, node, done, "state", *state, None, None) for node, state in touched.items()]

    def wait(self, timers) -> None:
        """A timer while something waits, none otherwise."""
        if self.patience_ms is None:
            return
        held = list(self.handle.listTimers())
        if next(iter(self.waiting.keys()), None) is None:
            for t in held:
                self.handle.deleteTimer(t)
        elif not held:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience_ms)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in FOLDED.split(", ")]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype({"seq": "Int64", "flips": "Int32", "odd": "Int32", "size": "Float64", "later": "Float64", "emptied": "boolean", "told": "boolean"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, late = self.done.get()[0] if self.done.exists() else 0, []
        for frame in rows:
            for seq, op, node, value in frame[["seq", "op", "node_id", "value"]].astype(object).where(frame.notna(), None).itertuples(index=False):
                if seq is None:
                    continue
                if seq > done:
                    if not self.waiting.containsKey((int(seq),)):
                        self.waiting.updateValue((int(seq),), (op, node, value))
                else:
                    late.append((int(seq), op, node, value))
        out = self.settle(key[0], skip=False)
        self.wait(timerValues)
        missed = [(a[0], b[0]) for a, b in self.missed.iterator()] if late else []
        for seq, op, node, value in late:
            if any(a <= seq <= b for a, b in missed):
                out.append((key[0], node, seq, "late", *[None] * 11, op, value))
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.settle(key[0], skip=True)
        self.wait(timerValues)
        if out:
            yield self.frame(out)

    def close(self) -> None:
        pass


def settled_edits(edits: DataFrame, patience_ms: int | None = 600_000) -> DataFrame:
    """A stream of edits (doc_id, seq, op, node_id, value) as rows of FOLDED, for update mode.

    The last row of kind state of a node holds. Of edits with one seq the first
    counts, and repeated ones change nothing; null seqs are left out. Without patience edits
    wait for their predecessors for ever; with it, batches without data run for its
    timers, and so a stream doesn't end by itself. Needs the RocksDB
    state store: set spark.sql.streaming.stateStore.providerClass to PROVIDER.
    """
    rows = edits.selectExpr("cast(doc_id as string) as doc_id", "cast(seq as long) as seq", "op", "node_id", "cast(value as string) as value")
    return rows.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Settler(patience_ms), outputStructType=FOLDED, outputMode="Update", timeMode="None" if patience_ms is None else "ProcessingTime")
