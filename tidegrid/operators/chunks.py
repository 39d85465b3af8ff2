"""Sorted Arrow batches cut where a group ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], key_column: str) -> Iterator[pd.DataFrame]:
    """The batches, cut at the borders of groups of equal keys; a group is held whole, so it must be bounded (say, one row per calendar day)."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf[key_column].to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if rest and rest[-1][key_column].iloc[-1] != key[0] and cut == 0:
            yield pd.concat(rest, ignore_index=True)
            rest = [pdf]
        elif cut:
            yield pd.concat([*rest, pdf.iloc[:cut]], ignore_index=True)
            rest = [pdf.iloc[cut:]]
        else:
            rest.append(pdf)
    if rest:
        yield pd.concat(rest, ignore_index=True)
