"""Sums up to each row, in an order that spans all tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_ENDS = "_part int, _head boolean, _single boolean, _first array<long>, _last array<long>, _tail array<long>"


def running_sums(scratch: Scratch, df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], sums: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep and, for each column of sums, {column}_to and {column}_before: its sum over the rows of the same keys up to this one, with and without it.

    Rows are dealt by ranges of (keys, order) and sorted, so that a key of any number of rows spans as many tasks as they
    need; rows equal in both should be equal in all. A task sums its own rows; what a key has in the tasks before is
    added when the table, which is saved, is read. The driver sees one row for each task. keys and sums are longs
    without nulls, order is any columns, sums go round at 64 bits.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    added = [f"{c}_{end}" for c in sums for end in ("to", "before")]
    schema = ", ".join([*fields, *(f"{c} long" for c in added), _ENDS])
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*keep, *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), *(F.col(c).alias(f"_s{i}") for i, c in enumerate(sums)))
    n_keep, n_keys = len(keep), len(keys)
    names = [*keep, *added, *(x.split()[0] for x in _ENDS.split(", "))]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, head, carry, kinds = TaskContext.get().partitionId(), None, None, True, np.zeros((len(sums), 1), np.int64), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kinds = [batch.column(i).type for i in range(n_keep)]
            own = [batch.column(n_keep + i).to_numpy() for i in range(n_keys)]
            values = [batch.column(n_keep + n_keys + i).to_numpy() for i in range(len(sums))]
            new = np.zeros(n, bool)
            for k in own:
                new[1:] |= k[1:] != k[:-1]
            begin = [int(k[0]) for k in own]
            first = begin if first is None else first
            new[0] = last is not None and begin != last
            starts, segment = np.flatnonzero(new), np.cumsum(new)
            columns = []
            for i, v in enumerate(values):
                total = np.cumsum(v)
                total += np.concatenate([carry[i], v[starts] - total[starts]])[segment]
                carry[i] = total[-1:]
                columns += [total, total - v]
            rest = [pa.nulls(n, pa.bool_()), *(pa.nulls(n, pa.list_(pa.int64())) for _ in range(3))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_keep)), *map(pa.array, columns), pa.array(np.full(n, part, np.int32)), pa.array((segment == 0) & head), *rest], names)
            head = head and not len(starts)
            last = [int(k[-1]) for k in own]
        if first is not None:
            own = [pa.nulls(1, k) for k in kinds] + [pa.nulls(1, pa.int64())] * len(added)
            ends = [pa.array([x], pa.list_(pa.int64())) for x in (first, last, carry[:, 0].tolist())]
            yield pa.RecordBatch.from_arrays([*own, pa.array([part], pa.int32()), pa.nulls(1, pa.bool_()), pa.array([head]), *ends], names)

    both = scratch.save(dealt.mapInArrow(local, schema), name)
    carries, key, so_far = {}, None, np.zeros(len(sums), np.int64)
    for end in sorted(both.where("_single is not null").select("_part", "_single", "_first", "_last", "_tail").collect(), key=lambda r: r["_part"]):
        before = so_far if list(end["_first"]) == key else np.zeros(len(sums), np.int64)
        if before.any():
            carries[end["_part"]] = before
        tail = np.array(end["_tail"], np.int64)
        key, so_far = list(end["_last"]), before + tail if end["_single"] else tail
    rows = both.where("_single is null")
    if not carries:
        return rows.select(*keep, *added)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.array(sorted(carries))
        table = np.stack([*(carries[p] for p in parts.tolist()), np.zeros(len(sums), np.int64)])
        for batch in batches:
            part, head = batch.column(n_keep + len(added)).to_numpy(), batch.column(n_keep + len(added) + 1).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(parts, part), len(parts) - 1)
            at = np.where(head & (parts[at] == part), at, len(parts))
            columns = [pa.array(batch.column(n_keep + i).to_numpy() + table[at, i // 2]) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_keep)), *columns], names[: n_keep + len(added)])

    return rows.select(*keep, *added, "_part", "_head").mapInArrow(carried, ", ".join([*fields, *(f"{c} long" for c in added)]))
