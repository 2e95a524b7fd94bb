"""The operators that follow a log while it is written."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracemine.operators.lives import Lives, given, plain
from tracemine.schemas import MAGIC, PLOG


def stream_log(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A log of JSON lines as a stream: the nested entries with ``trace_id`` (the file)."""
    return spark.readStream.schema(PLOG).option("maxFilesPerTrigger", max_files).json(path).withColumn("trace_id", F.col("_metadata.file_path"))


def stream_liveness(branches: DataFrame) -> DataFrame:
    """``inputfile``, ``label``, ``death_instr``: continuously updated liveness of a stream of branch labels (update mode)."""
    return branches.groupBy("inputfile", "label").agg(F.count("*").alias("death_instr"))


def stream_counters(entries: DataFrame) -> DataFrame:
    """``kind``, ``n`` (update or complete mode)."""
    return entries.groupBy("kind").agg(F.count("*").alias("n"))


#: The store that keyed map state needs; set it in the session before the stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Kept:
    """A map in the state store, as Lives uses one: an entry is read when it is asked for, and written back once at the end of a batch if it has changed."""

    def __init__(self, state: Any, read: Callable, write: Callable):
        self.state, self.read, self.write = state, read, write
        self.known: dict = {}
        self.changed: set = set()

    def get(self, key, default=None):
        if key not in self.known:
            value = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
            self.known[key] = None if value is None else self.read(value)
        value = self.known[key]
        return default if value is None else value

    def __setitem__(self, key, value) -> None:
        self.known[key] = value
        self.changed.add(key)

    def pop(self, key, default=None):
        value = self.get(key, default)
        self[key] = None
        return value

    def flush(self) -> None:
        for key in self.changed:
            if self.known[key] is not None:
                self.state.updateValue((key,), self.write(self.known[key]))
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))


class _DuaState(StatefulProcessor):
    """Keyed by trace: a map entry for each label's liveness, each lvalue's live DUA and each label's holders, and the last seq that has been taken."""

    def __init__(self, max_liveness: int, n: int, erase_siblings: bool):
        self.rule = (max_liveness, n, erase_siblings)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "label LONG", "n LONG")
        self.alive = handle.getMapState("alive", "lval STRING", "seq LONG, fake BOOLEAN, nodua BOOLEAN, labels STRING")
        self.holders = handle.getMapState("holders", "label LONG", "lvals STRING")
        self.last = handle.getValueState("last", "seq LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        live = _Kept(self.live, lambda v: v[0], lambda n: (n,))
        alive = _Kept(self.alive, lambda v: (v[0], v[1], v[2], json.loads(v[3])), lambda d: (*d[:3], json.dumps(d[3])))
        holders = _Kept(self.holders, lambda v: set(json.loads(v[0])), lambda s: (json.dumps(sorted(s)),))
        lives = Lives(*self.rule, live, alive, holders)
        last, out = self.last.get()[0] if self.last.exists() else -1, []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            seq = int(r.seq)
            if seq <= last:
                out.append((key[0], r.lval, seq, None, "late"))
                continue
            last, labels = seq, plain(r.labels)
            if r.lval is None:
                happened = lives.branch(x for b in labels for x in b or ())
            else:
                tainted = given(r, "num_tainted")
                happened = lives.query(seq, r.lval, labels, None if tainted is None else int(tainted), bool(given(r, "fake", False)), bool(given(r, "nodua", False)))
            out += [(key[0], lval, seq, since, what) for lval, since, what in happened]
        for kept in (live, alive, holders):
            kept.flush()
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["trace_id", "lval", "seq", "since", "what"]).astype({"seq": "int64", "since": "Int64"})

    def close(self) -> None:
        pass


def stream_dua_state(events: DataFrame, max_liveness: int, n: int = MAGIC, erase_siblings: bool = False) -> DataFrame:
    """Rows ``trace_id``, ``lval``, ``seq``, ``since``, ``what``: DUAs that are born, replaced, or die (``since``: when they were born), as events of their trace arrive (append mode).

    events: as for the exact replay, with ``num_tainted``, ``fake`` and ``nodua`` if there are any. State is keyed by trace and kept as map entries, one per label and per lvalue: a batch reads
    and writes those that its rows touch, however long the trace is. Rows are put in order within a batch. An entry whose seq is not beyond the last one taken of its trace came too late: it is
    reported (``late``) and changes nothing. The session needs the settings of STATE_STORE.
    """
    schema = "trace_id string, lval string, seq long, since long, what string"
    return events.groupBy("trace_id").transformWithStateInPandas(_DuaState(max_liveness, n, erase_siblings), schema, "Append", "None")
