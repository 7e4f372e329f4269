"""Ordered folds per key that survive hot keys.

Counters, limits and running text need their rows in order, key by key. A window or a grouped function would put a
whole key into one task, and one key may hold a third of all rows. Instead:

1. the rows are range-partitioned by key and order, so a hot key spans several partitions (segments), and the sorted
   segments are checkpointed, which fixes their boundaries;
2. every segment summarises its first and its last key, the only ones that can continue elsewhere;
3. the summaries of a key, one per segment, are chained in segment order: that yields the state each segment starts
   with (at most two rows per segment, so they are broadcast). Of many segments, runs of ``RUN`` are merged into one summary
   first, and runs of these, until few are left; states then come back down the same tree, so no task reads more than a run;
4. every segment folds its rows from its start state, in parallel.

It works for any fold whose segments can be summarised as "incoming state -> outgoing state".
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import shared_dir

RUN = 32  # summaries that a task merges or chains at a time


class Fold(Protocol):
    """The small pieces of a fold; rows arrive as lists of column values in order."""

    def start(self, key: Any) -> Any: ...  # state before the first row

    def summarize(self, rows: pd.DataFrame) -> Any: ...  # what a run of rows does to any incoming state

    def merge(self, first: Any, second: Any) -> Any: ...  # summary of a run from those of its two parts, never None

    def advance(self, state: Any, summary: Any) -> Any: ...  # incoming state + summary -> outgoing state

    def emit(self, state: Any, rows: pd.DataFrame) -> tuple[Any, pd.DataFrame]: ...  # outgoing state, output rows


def _runs(pdf: pd.DataFrame, key: str) -> Iterator[tuple[Any, pd.DataFrame]]:
    """Consecutive rows of one key."""
    if len(pdf):
        cuts = (pdf[key] != pdf[key].shift()).cumsum()
        for _, run in pdf.groupby(cuts, sort=False):
            yield run[key].iloc[0], run


def _summaries(fold: Fold, key: str) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """First and last key of the segment with their summaries; a run that spans batches is summarised batch by batch."""

    def one(seg: int, k: Any, summary: Any, pending: pd.DataFrame | None) -> pd.DataFrame:
        return pd.DataFrame({"_seg": [seg], key: [k], "_summary": [pickle.dumps(merged(summary, pending))]})

    def merged(summary: Any, pending: pd.DataFrame | None) -> Any:
        if pending is None:
            return summary
        own = fold.summarize(pending)
        return own if summary is None else fold.merge(summary, own)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg, current, summary, pending, keys = 0, None, None, None, 0
        for pdf in batches:
            for k, rows in _runs(pdf, key):
                seg = int(rows["_seg"].iloc[0])
                if keys and k == current:
                    summary, pending = merged(summary, pending), rows
                    continue
                if keys == 1:
                    yield one(seg, current, summary, pending)
                keys, current, summary, pending = keys + 1, k, None, rows
        if keys:
            yield one(seg, current, summary, pending)

    return run


def _merged(fold: Fold, key: str) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One summary for each key and run of segments, from those of the run in order."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, summary = None, None
        for pdf in batches:
            out = []
            for k, at, blob in zip(pdf[key], pdf["_run"], pdf["_summary"]):
                if current is not None and (k, at) == current:
                    summary = fold.merge(summary, pickle.loads(blob))
                    continue
                if current is not None:
                    out.append((current[1], current[0], pickle.dumps(summary)))
                current, summary = (k, at), pickle.loads(blob)
            yield pd.DataFrame(out, columns=["_seg", key, "_summary"])
        if current is not None:
            yield pd.DataFrame([(current[1], current[0], pickle.dumps(summary))], columns=["_seg", key, "_summary"])

    return run


def _chained(fold: Fold, key: str) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Chains the summaries of each key and run in order, from the run's own start state; emits the start state of every segment."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, first = None, None, True
        for pdf in batches:
            out = []
            for k, at, seg, blob, begin in zip(pdf[key], pdf["_run"], pdf["_seg"], pdf["_summary"], pdf["_begin"]):
                if first or (k, at) != current:
                    current, first = (k, at), False
                    state = fold.start(k) if begin is None else pickle.loads(begin)
                out.append((seg, k, pickle.dumps(state)))
                state = fold.advance(state, pickle.loads(blob))
            yield pd.DataFrame(out, columns=["_seg", key, "_state"])

    return run


def start_states(summaries: DataFrame, key: str, key_type: str, fold: Fold, segments: int, run: int = RUN) -> DataFrame:
    """``(_seg, key, _state)``: the state each segment of a key starts with, from a summary per segment (numbered below ``segments``).

    Up the tree, ``run`` neighbours become one summary until a key has no more than that many; down it, each level's states
    start the runs of the level below.
    """
    levels = [summaries]
    while segments > run:
        dealt = levels[-1].withColumn("_run", F.floor(F.col("_seg") / run).cast("int")).repartition(key, "_run").sortWithinPartitions(key, "_run", "_seg")
        levels.append(dealt.mapInPandas(_merged(fold, key), f"_seg int, `{key}` {key_type}, _summary binary"))
        segments = -(-segments // run)
    states = None
    for level in reversed(levels):
        rows = level.withColumn("_run", (F.floor(F.col("_seg") / run) if states is not None else F.lit(0)).cast("int"))
        if states is None:
            rows = rows.withColumn("_begin", F.lit(None).cast("binary"))
        else:
            above = states.select(F.col("_seg").alias("_above"), F.col(key).alias("_key"), F.col("_state").alias("_begin"))
            rows = rows.join(above, (F.col("_run") == F.col("_above")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_above", "_key")
        dealt = rows.repartition(key, "_run").sortWithinPartitions(key, "_run", "_seg")
        states = dealt.mapInPandas(_chained(fold, key), f"_seg int, `{key}` {key_type}, _state binary")
    return states


def _emits(fold: Fold, key: str) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, first = None, None, True
        for pdf in batches:
            for k, rows in _runs(pdf, key):
                if first or k != current:
                    blob = rows["_state"].iloc[0]
                    state = pickle.loads(blob) if blob is not None else fold.start(k)
                    current, first = k, False
                state, out = fold.emit(state, rows)
                yield out

    return run


def ordered_fold(df: DataFrame, key: str, order: list[str], fold: Fold, schema: str) -> DataFrame:
    """Runs ``fold`` over the rows of each key in ``order``; ``schema`` is that of the emitted rows."""
    shared_dir(df.sparkSession)
    segments = (
        df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
        .withColumn("_seg", F.spark_partition_id()).checkpoint()
    )
    key_type = df.schema[key].dataType.simpleString()
    summaries = segments.mapInPandas(_summaries(fold, key), f"_seg int, `{key}` {key_type}, _summary binary")
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # ranges that the rows were dealt to, at most
    starts = start_states(summaries, key, key_type, fold, most)
    # Two rows per segment at most, whatever the size of the data: a fixed bound, so the broadcast is safe.
    with_state = segments.join(F.broadcast(starts), ["_seg", key], "left")
    return with_state.mapInPandas(_emits(fold, key), schema)
