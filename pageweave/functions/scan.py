"""Running values over the ordered rows of groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pageweave.functions.scratch import saved

#: Values by name: of one state plain numbers, of the states of many rows arrays.
State = dict[str, np.ndarray]


def _starts(batch: pa.RecordBatch, group: list[str]) -> np.ndarray:
    """Whether a row's group is another one than that of the row before; false for the first row."""
    new = np.zeros(batch.num_rows, bool)
    for name in group:
        x, y = batch[name][1:], batch[name][:-1]
        new[1:] |= np.asarray(pc.coalesce(pc.not_equal(x, y), pc.xor(pc.is_null(x), pc.is_null(y))))
    return new


def _row(batch: pa.RecordBatch, k: int, names: list[str]) -> tuple:
    return tuple(batch[n][k].as_py() for n in names)


def scan(
    df: DataFrame,
    group: list[str],
    order: list[str],
    state: str,
    local: Callable[[dict[str, np.ndarray], np.ndarray], State],
    combine: Callable[[State, State], State],
    name: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` (its columns ``keep``) with the columns of ``state``: the running state up to and with each row of a group.

    Rows are range partitioned and sorted by ``group`` and ``order`` (ascending, nulls first; no group: all rows are one), so
    a group of any size lies over as many tasks as its rows fill. ``local`` gets columns (numpy arrays) of
    some consecutive rows and where new groups start, and returns the states within them; ``combine(a, b)`` prepends a
    state to later ones and has to be associative. A task reads its rows as a stream of batches. Only the last state of each
    partition meets in the driver: as many rows as a shuffle has partitions. Rows that are equal in group and order stand in
    an arbitrary order. The table is written once to the shared folder.
    """
    spark = df.sparkSession
    fields = StructType.fromDDL(state).fieldNames()
    names = keep if keep is not None else df.columns
    hidden = "__p int, __n long, __open boolean"
    first = StructType([df.schema[n] for n in names] + StructType.fromDDL(f"{state}, {hidden}").fields)
    arrow = to_arrow_schema(first)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, carry, one = TaskContext.get().partitionId(), 0, None, None, True
        for b in batches:
            if not b.num_rows:
                continue
            starts = _starts(b, group)
            here = local({n: b[n].to_numpy(zero_copy_only=False) for n in b.schema.names if not pa.types.is_nested(b[n].type)}, starts)
            begins = np.flatnonzero(starts)
            head = begins[0] if len(begins) else b.num_rows
            if last is not None and _row(b, 0, group) == last:
                joined = combine(carry, {f: here[f][:head] for f in fields})
                here = {f: np.concatenate([joined[f], here[f][head:]]) for f in fields}
            else:
                one = one and last is None
            opened = np.zeros(b.num_rows, bool)
            opened[:head] = one
            one = one and not len(begins)
            last, carry = _row(b, b.num_rows - 1, group), {f: here[f][-1] for f in fields}
            cells = [b[n] for n in names] + [pa.array(here[f]) for f in fields]
            cells += [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(seen, seen + b.num_rows)), pa.array(opened)]
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)

    by = [*group, *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    found = saved(rows.mapInArrow(forward, first), name)
    ends = found.groupBy("__p").agg(
        F.min_by(F.struct(F.lit(0), *group), "__n").alias("first"),
        F.max_by(F.struct(F.struct(F.lit(0), *group).alias("g"), F.struct(*fields).alias("s")), "__n").alias("last"),
    )
    before, carry, carries = None, None, {}
    for r in sorted(ends.collect()):  # a row for each partition
        mine = {f: np.array([r["last"]["s"][f]]) for f in fields}
        goes_on = before is not None and r["first"] == before
        if goes_on:
            carries[r["__p"]] = carry
        if goes_on and r["last"]["g"] == before:
            mine = combine(carry, mine)
        before, carry = r["last"]["g"], {f: mine[f][0] for f in fields}
    out = StructType([df.schema[n] for n in names] + StructType.fromDDL(state).fields)
    shape = to_arrow_schema(out)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells = {f: b[f] for f in fields}
            parts, opened = b["__p"].to_numpy(), b["__open"].to_numpy(zero_copy_only=False)
            for p in np.unique(parts[opened]) if opened.any() else ():
                if int(p) in carries:
                    here = {f: pa.array(cells[f]).to_numpy(zero_copy_only=False) for f in fields}
                    at = opened & (parts == p)
                    joined = combine(carries[int(p)], {f: here[f][at] for f in fields})
                    for f in fields:
                        v = np.array(here[f])
                        v[at] = joined[f]
                        cells[f] = pa.array(v)
            every = [b[n] for n in names] + [cells[f] for f in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(every, shape, strict=True)], schema=shape)

    if not carries:
        return found.select(*names, *fields)
    return found.mapInArrow(mend, out)


def _within(values: np.ndarray, starts: np.ndarray, running: np.ufunc, undo: np.ufunc) -> np.ndarray:
    """Running values that begin anew at ``starts``, of an operation that can be undone."""
    whole = running.accumulate(values)
    begins = np.flatnonzero(starts)
    if not len(begins):
        return whole
    base = np.zeros(len(values), whole.dtype)
    base[begins] = whole[begins - 1]
    at = np.where(starts, np.arange(len(values)), 0)
    base = base[np.maximum.accumulate(at)]
    return undo(whole, base)


def sums(**columns: str) -> dict:
    """Arguments of ``scan`` for running sums of integer columns (``'1'`` counts rows): ``sums(place="1")``."""

    def local(cols: dict, starts: np.ndarray) -> State:
        values = {k: np.ones(len(starts), np.int64) if c == "1" else cols[c].astype(np.int64) for k, c in columns.items()}
        return {k: _within(v, starts, np.add, np.subtract) for k, v in values.items()}

    def combine(a: State, b: State) -> State:
        return {k: a[k] + b[k] for k in columns}

    return {"state": ", ".join(f"{k} bigint" for k in columns), "local": local, "combine": combine}


def xors(**columns: str) -> dict:
    """Arguments of ``scan`` for running exclusive ors of bigint columns."""

    def local(cols: dict, starts: np.ndarray) -> State:
        return {k: _within(cols[c].astype(np.int64), starts, np.bitwise_xor, np.bitwise_xor) for k, c in columns.items()}

    def combine(a: State, b: State) -> State:
        return {k: a[k] ^ b[k] for k in columns}

    return {"state": ", ".join(f"{k} bigint" for k in columns), "local": local, "combine": combine}


def schedule(delay: float, arrive: str) -> dict:
    """Arguments of ``scan`` for starts at least ``delay`` apart: ``i`` counts the rows, ``peak`` is the largest arrival minus
    place times delay. Nulls arrive at no time of their own."""

    def local(cols: dict, starts: np.ndarray) -> State:
        i = _within(np.ones(len(starts), np.int64), starts, np.add, np.subtract)
        rest = pd.Series(cols[arrive].astype(np.float64) - (i - 1) * delay)
        peak = rest.groupby(np.cumsum(starts)).cummax()  # passes over nulls, so fill them from before
        return {"i": i, "peak": peak.groupby(np.cumsum(starts)).ffill().to_numpy()}

    def combine(a: State, b: State) -> State:
        return {"i": a["i"] + b["i"], "peak": np.fmax(a["peak"], b["peak"] - a["i"] * delay)}

    return {"state": "i bigint, peak double", "local": local, "combine": combine}
