"""Grouped pandas functions for very many small groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa


def by_group(rows: DataFrame, keys: list[str], solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str, at_once: int = 20_000) -> DataFrame:
    """``solve`` of each group, as ``applyInPandas`` has it, but groups share Arrow batches.

    Rows are dealt by key and sorted, so that a task streams its groups and holds one at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        now, out, n = None, [], 0
        for pdf in frames:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                key = tuple(None if k != k else k for k in key)  # a null is no NaN
                if key != now and held:
                    out.append(solve(pd.concat(held) if len(held) > 1 else held[0]))
                    n += len(out[-1])
                    held = []
                now = key
                held.append(part)
                if n >= at_once:
                    yield pd.concat(out)
                    out, n = [], 0
        if held:
            out.append(solve(pd.concat(held) if len(held) > 1 else held[0]))
        out = [x for x in out if len(x)]
        if out:
            yield pd.concat(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def by_group_arrays(rows: DataFrame, keys: list[str], solve: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], schema: str, at_once: int = 20_000) -> DataFrame:
    """``solve`` of each group as arrays of the columns that follow the keys: for groups so small that a pandas frame each would cost more than their work.

    Rows are dealt and streamed as in ``by_group``; ``schema`` names the keys first.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    to = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        held: list[pa.RecordBatch] = []
        now, names, found, n = None, [], [], 0

        def close() -> int:
            part = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            names.append(now)
            found.append(solve(part))
            held.clear()
            return len(found[-1][0])

        def packed() -> pa.RecordBatch:
            at = pa.array(np.repeat(np.arange(len(names)), [len(x[0]) for x in found]))
            columns = [pa.array(k, f.type).take(at) for k, f in zip(zip(*names, strict=True), to, strict=False)]
            columns += [pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found, strict=True), list(to)[len(keys) :], strict=True)]
            names.clear()
            found.clear()
            return pa.RecordBatch.from_arrays(columns, schema=to)

        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                key = tuple(b.column(k)[start].as_py() for k in keys)
                if held and key != now:
                    n += close()
                    if n >= at_once:
                        yield packed()
                        n = 0
                now = key
                held.append(b.slice(start, end - start))
        if held:
            close()
        if found:
            yield packed()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
