"""Greedy chains: the rows of a key that a pass in order would pick, each pick deciding where the next one is sought.

Whether a row is picked depends on all before it, but only through the last
pick. So a key is cut into ranges of time. For each range a map is made, side
by side, from the pick that a range is entered with to the pick it is left
with: entries differ only in how many of the range's first rows they skip, and
the chains from there run together soon. One map a range is composed along the
key; then the ranges are walked again side by side, each from its own entry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions.ranges import RANGE, ranged

#: For picks at these times, sought from these rows on: the rows of the next picks.
Jump = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: A rule: the jumps among rows, given as columns in order.
Rule = Callable[[dict[str, np.ndarray]], Jump]


def spaced(spacing_ms: int) -> Rule:
    """The next pick is the first row at least ``spacing_ms`` after the last."""
    return lambda rows: lambda ts, at: np.maximum(at, np.searchsorted(rows["ts_ms"], ts + spacing_ms, "left"))


def bursts(gap_ms: int, min_qty: float) -> Rule:
    """The next pick is the first row that is more than ``gap_ms`` after the last, or smaller than ``min_qty``."""

    def among(rows: dict[str, np.ndarray]) -> Jump:
        n = len(rows["ts_ms"])
        small = np.where(rows["qty"] < min_qty, np.arange(n), n)
        next_small = np.r_[np.minimum.accumulate(small[::-1])[::-1], n]
        return lambda ts, at: np.maximum(at, np.minimum(np.searchsorted(rows["ts_ms"], ts + gap_ms, "right"), next_small[at]))

    return among


def _ends(nxt: np.ndarray) -> np.ndarray:
    """The last pick of the chain from each row, by doubling the pointers."""
    n = len(nxt)
    to = np.where(nxt < n, nxt, np.arange(n))
    while (to[to] != to).any():
        to = to[to]
    return to


def _columns(table: pa.Table, names: Sequence[str]) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy() for c in names}


def _entry_map(ts: np.ndarray, jump: Jump) -> tuple[list[int], list[int | None]]:
    """Runs of entries: from which time of the last pick on, and the row that the range is left with (None: the entry itself)."""
    n = len(ts)
    ends = _ends(jump(ts, np.arange(n) + 1))
    # No entry is later than the first row, so none skips more rows than that row would.
    most = int(jump(ts[:1], np.zeros(1, np.int64))[0])
    starts: list[int] = []
    left: list[int | None] = []
    lo, last = None, -1
    for skipped in range(most + 1):
        end = int(ends[skipped]) if skipped < n else None
        if skipped and end == last:
            continue
        if skipped:
            # The least time whose pick skips so many: the rule is monotone in it.
            lo = _least_time(jump, skipped, int(ts[0]))
        starts.append(-(1 << 62) if lo is None else lo)
        left.append(end)
        last = end
    return starts, left


def _least_time(jump: Jump, skipped: int, high: int) -> int:
    low, step = high, 1
    enters = lambda t: int(jump(np.array([t]), np.zeros(1, np.int64))[0]) >= skipped
    while enters(low - step):
        step *= 2
    low, high = low - step, low - step // 2 if step > 1 else low
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if enters(middle) else (middle, high)
    return high


def with_chains(df: DataFrame, keys: Sequence[str], order: Sequence[str], rule: Rule, width: int, reads: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """Add ``chain``, the number of the pick that a row belongs to, and ``picked``.

    The first row of a key is picked. ``order`` begins with ``ts_ms``; ``reads`` are the columns that the rule looks at.
    Rows before a key's first pick don't exist, so every row belongs to the last pick at or before it.
    """
    rows = ranged(df, "ts_ms", width)
    place = [*keys, RANGE]
    by = [(c, "ascending") for c in order]
    key_fields = [df.schema[k] for k in keys]
    number = T.StructField(RANGE, T.LongType())

    def mapped(key: tuple, table: pa.Table) -> pa.Table:
        columns = _columns(table.sort_by(by), reads)
        starts, left = _entry_map(columns["ts_ms"], rule(columns))
        ts, range_number = columns["ts_ms"], key[-1].as_py()
        out = {k: pa.array([v.as_py()], table.schema.field(k).type) for k, v in zip(keys, key, strict=False)}
        out |= {RANGE: pa.array([range_number], pa.int64()), "starts": pa.array([starts], pa.list_(pa.int64()))}
        out["times"] = pa.array([[None if e is None else int(ts[e]) for e in left]], pa.list_(pa.int64()))
        out["picks"] = pa.array([[None if e is None else (range_number << 31) + e for e in left]], pa.list_(pa.int64()))
        return pa.table(out)

    def composed(key: tuple, table: pa.Table) -> pa.Table:
        """One row a range: the pick it is entered with."""
        time = pick = None
        entries = []
        for r in table.sort_by(RANGE).to_pylist():
            entries.append((r[RANGE], time, pick))
            run = 0 if time is None else int(np.searchsorted(r["starts"], time, "right")) - 1
            if r["picks"][run] is not None:
                time, pick = r["times"][run], r["picks"][run]
        out = {k: pa.array([v.as_py()] * len(entries), table.schema.field(k).type) for k, v in zip(keys, key, strict=True)}
        for i, c in enumerate((RANGE, "entry_time", "entry_pick")):
            out[c] = pa.array([e[i] for e in entries], pa.int64())
        return pa.table(out)

    def walked(key: tuple, table: pa.Table, entry: pa.Table) -> pa.Table:
        table = table.sort_by(by)
        columns, n = _columns(table, reads), table.num_rows
        (time,), (pick,) = entry.column("entry_time").to_pylist(), entry.column("entry_pick").to_pylist()
        jump = rule(columns)
        nxt = jump(columns["ts_ms"], np.arange(n) + 1)
        at = 0 if time is None else int(jump(np.array([time]), np.zeros(1, np.int64))[0])
        picked, chain = np.zeros(n, bool), np.full(n, -1 if pick is None else pick, np.int64)
        while at < n:
            picked[at], chain[at : nxt[at]] = True, (key[-1].as_py() << 31) + at
            at = int(nxt[at])
        return table.drop_columns([RANGE]).append_column("chain", pa.array(chain)).append_column("picked", pa.array(picked))

    longs = T.ArrayType(T.LongType())
    maps = rows.select(*keys, RANGE, *[c for c in dict.fromkeys([*order, *reads])]).groupBy(*place).applyInArrow(
        mapped, T.StructType([*key_fields, number, T.StructField("starts", longs), T.StructField("times", longs), T.StructField("picks", longs)])
    )
    entries = maps.groupBy(*keys).applyInArrow(composed, T.StructType([*key_fields, number, T.StructField("entry_time", T.LongType()), T.StructField("entry_pick", T.LongType())]))
    schema = T.StructType([*df.schema.fields, T.StructField("chain", T.LongType()), T.StructField("picked", T.BooleanType())])
    return rows.groupBy(*place).cogroup(entries.groupBy(*place)).applyInArrow(walked, schema)
