"""Recursions over ordered rows, one key after another, in bounded memory.

A fold is a class with ``step(row) -> tuple | None`` (and ``finish``); one object
per key. A fold that also has ``run(columns) -> list of tuples`` takes a key's
rows of a batch at once. Rows arrive sorted by key and order, so that a key of any length passes
in Arrow batches and only the fold's state is kept. A recursion is sequential
within its key by nature; keys are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _changes(f: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Where a key begins, in rows sorted by key; nulls are one key."""
    new = np.arange(len(f)) == 0
    for k in keys:
        before = f[k].shift()
        new |= ((f[k] != before) & ~(f[k].isna() & before.isna())).to_numpy(bool)
    return new


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], object], inputs: Sequence[str], schema: str) -> DataFrame:
    """Rows (keys, what ``step`` gives) wherever ``step`` gives something; ``schema`` is of those values."""
    keys, inputs = list(keys), list(inputs)
    key_types = dict(df.select(*keys).dtypes)
    full = ", ".join(f"`{k}` {key_types[k]}" for k in keys) + (", " if keys else "") + schema
    in_batches = hasattr(make(), "run")
    names = [*keys, *(c.strip().split()[0].strip("`") for c in schema.split(","))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fold = object(), None
        for f in frames:
            out = []
            if in_batches:
                starts = np.flatnonzero(_changes(f, keys)).tolist()
                for a, b in zip(starts, [*starts[1:], len(f)]):
                    key = tuple(f[k].iat[a] for k in keys)
                    if key != current:
                        current, fold = key, make()
                    out.extend(key + got for got in fold.run(*(f[c].array[a:b] for c in inputs)))
            else:
                for row in zip(*(f[c].tolist() for c in [*keys, *inputs])):
                    key = row[: len(keys)]
                    if key != current:
                        current, fold = key, make()
                    got = fold.step(*row[len(keys) :])
                    if got is not None:
                        out.append(key + got)
            yield pd.DataFrame(out, columns=names)

    parts = df.select(*dict.fromkeys([*keys, *order, *inputs]))
    parts = parts.repartition(*keys) if keys else parts.coalesce(1)
    return parts.sortWithinPartitions(*keys, *order).mapInPandas(run, full)
