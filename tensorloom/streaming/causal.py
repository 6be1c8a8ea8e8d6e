"""A causal filter and gate over series that never end: a few numbers of state a series, whatever its length."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class State(NamedTuple):
    """Of a series: the filter's two delays, how many values there were and the sum of what the filter left, the last time."""

    z1: float = 0.0
    z2: float = 0.0
    n: int = 0
    total: float = 0.0
    last: pd.Timestamp | None = None


_STATE = "z1 double, z2 double, n long, total double, last timestamp"


def advance(state: State, pdf: pd.DataFrame, time: str, value: str, low: float) -> tuple[State, pd.DataFrame]:
    """The state after the rows, taken by time, and the rows with low, mean, above and late.

    low: a second-order Butterworth low-pass with its corner at `low` cycles a sample, from rest; mean: of all value - low so far;
    above: whether value - low is at least that. A row earlier than the last one taken is late: it changes nothing and has
    no results. A null value has none either.
    """
    k = math.tan(math.pi * low)
    scale = 1 + k * math.sqrt(2) + k * k
    b0, a1, a2 = k * k / scale, 2 * (k * k - 1) / scale, (1 - k * math.sqrt(2) + k * k) / scale
    pdf = pdf.sort_values([time, value], kind="stable")
    z1, z2, n, total, last = state
    out: list[tuple] = []
    for t, v in zip(pdf[time], pdf[value], strict=True):
        late = last is not None and t < last
        if late or v is None or v != v:
            out.append((None, None, None, late))
            continue
        y = b0 * v + z1
        z1, z2 = 2 * b0 * v - a1 * y + z2, b0 * v - a2 * y
        n, total, last = n + 1, total + v - y, t
        out.append((y, total / n, v - y >= total / n, False))
    return State(z1, z2, n, total, last), pdf.assign(**{name: [o[i] for o in out] for i, name in enumerate(("low", "mean", "above", "late"))})


def _schema(df: DataFrame) -> T.StructType:
    out = T.StructType([f for f in df.schema.fields])
    return out.add("low", "double").add("mean", "double").add("above", "boolean").add("late", "boolean")


def causal_gate(events: DataFrame, series: str, time: str, value: str, low: float = 0.01) -> DataFrame:
    """`events` with low, mean, above and late (see `advance`), series by series in time order.

    A stream keeps a `State` for each series between micro-batches (append them in any split: the results are those of the
    batch form, as long as a series' rows do not come late; rows of one time stay in the order of their arrival). A static
    table goes through its partitions sorted, an Arrow batch at a time, so that no task holds a series. Rows without a
    time or series are left out.
    """
    known = events.where(F.col(series).isNotNull() & F.col(time).isNotNull())
    schema = _schema(events)
    columns = schema.names
    if events.isStreaming:

        def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
            state = State(*held.get) if held.exists else State()
            rows = pd.concat(list(batches))
            state, done = advance(state, rows, time, value, low)
            if state.last is not None:
                held.update(tuple(state))
            yield done[columns]

        return known.groupBy(series).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.NoTimeout)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, State()
        for batch in batches:
            for key, rows in batch.groupby(series, sort=False):
                state = state if key == at else State()
                at = key
                state, done = advance(state, rows, time, value, low)
                yield done[columns]

    return known.repartition(series).sortWithinPartitions(series, time, value).mapInPandas(run, schema)
