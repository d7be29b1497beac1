"""Rows of many keys as one value of a stream's state.

Keys are dealt to ``BUCKETS`` and a bucket's rows are handled together, as frames: a call to the
state costs the same for one row as for a frame of thousands.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 2048  # part of what a checkpoint holds
FRAMES = 8  # of so many frames one is made


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def packed(frame: pd.DataFrame) -> tuple[bytes]:
    import pyarrow as pa

    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def unpacked(values: Iterable[tuple]) -> pd.DataFrame | None:
    """One frame of all, in order; None of none."""
    import pyarrow as pa

    tables = [pa.ipc.open_stream(bytes(v[0])).read_all() for v in values]
    return pa.concat_tables(tables, promote_options="permissive").to_pandas() if tables else None


class Alarm:
    """A bucket's timer, at the earliest time asked for."""

    def __init__(self, handle):
        self.handle, self.state = handle, handle.getValueState("alarm", "at long")

    def by(self, at: int) -> None:
        set_to = self.state.get()
        if set_to is not None:
            if set_to[0] <= at:
                return
            self.handle.deleteTimer(set_to[0])
        self.handle.registerTimer(at)
        self.state.update((at,))

    def rang(self) -> None:
        self.state.clear()
