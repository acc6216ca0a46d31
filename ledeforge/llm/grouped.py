"""Streaming over sorted groups inside ``mapInPandas``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def group_arrays(batches: Iterator[pd.DataFrame], keys: list[str], cols: list[str], least: int = 2) -> Iterator[dict[str, np.ndarray]]:
    """The rows of one key at a time from sorted batches, however these cut them, as arrays by column; keys with fewer than ``least`` rows are passed over."""
    rest: dict[str, np.ndarray] | None = None
    names = [*keys, *(c for c in cols if c not in keys)]
    for b in batches:
        now = {c: b[c].to_numpy() for c in names}
        if rest is not None:
            now = {c: np.concatenate([rest[c], v]) for c, v in now.items()}
        size = len(now[keys[0]])
        if not size:
            continue
        new = np.zeros(size, dtype=bool)
        for k in keys:
            new[1:] |= now[k][1:] != now[k][:-1]
        starts = np.concatenate([[0], np.flatnonzero(new)])
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo >= least:
                yield {c: v[lo:hi] for c, v in now.items()}
        rest = {c: v[starts[-1] :] for c, v in now.items()}
    if rest is not None and len(rest[keys[0]]) >= least:
        yield rest
