"""Frame-ordered state machines over bounded memory.

Rows are hash-partitioned by recording and sorted inside each partition; the state
machine then sees one frame at a time and keeps only its live state, never a whole
recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ordered_map(
    df: DataFrame, keys: Sequence[str], frame: str, order: Sequence[str],
    machine: Callable[[], object], schema: str,
) -> DataFrame:
    """``machine()`` makes an object with ``step(rows) -> list of tuples``; a new one is made
    for every key.  ``rows`` maps column names to the arrays of one frame; the tuples follow
    ``schema``."""
    keys, order = list(keys), list(order)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, held = None, None, None

        def feed(cols, a, b):
            nonlocal current, state
            k = tuple(cols[c][a] for c in keys)
            if k != current:
                current, state = k, machine()
            return state.step({c: v[a:b] for c, v in cols.items()})

        def arrays(pdf):
            return {c: pdf[c].to_numpy() for c in pdf.columns}

        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
                held = None
            if not len(pdf):
                continue
            cols = arrays(pdf)
            cut = np.zeros(len(pdf), bool)
            cut[0] = True
            for c in keys + [frame]:
                cut[1:] |= cols[c][1:] != cols[c][:-1]
            start = cut.nonzero()[0].tolist()
            out = []
            for a, b in zip(start[:-1], start[1:]):
                out += feed(cols, a, b)
            held = pdf.iloc[start[-1]:].reset_index(drop=True)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held is not None:
            cols = arrays(held)
            out = feed(cols, 0, len(held))
            if out:
                yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, frame, *order).mapInPandas(run, schema)
