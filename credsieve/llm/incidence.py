"""Sparse matrices in compressed rows, and Gustavson's product of two of them."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from credsieve.llm.common import ship


class Rows(NamedTuple):
    """Row ``i`` has its columns at ``columns[starts[i]:starts[i + 1]]``; ``width`` columns in all."""

    starts: np.ndarray
    columns: np.ndarray
    width: int


def from_lengths(lengths: np.ndarray) -> Rows:
    """Rows that follow each other over consecutive columns: tokens over the bytes they cover."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return Rows(starts, np.arange(starts[-1], dtype=np.int64), int(starts[-1]))


def one_each(columns: np.ndarray, width: int) -> Rows:
    """One column a row: tokens and the group they lie in."""
    return Rows(np.arange(len(columns) + 1, dtype=np.int64), columns.astype(np.int64), width)


def transposed(m: Rows) -> Rows:
    """Columns become rows; within each the old rows stay in order."""
    rows = np.repeat(np.arange(len(m.starts) - 1, dtype=np.int64), np.diff(m.starts))
    counts = np.bincount(m.columns, minlength=m.width)
    return Rows(
        np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), rows[np.argsort(m.columns, kind="stable")], len(m.starts) - 1
    )


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` for ``lengths[i]`` places, one range after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.empty(0, np.int64)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def partial_sizes(a: Rows, b: Rows) -> np.ndarray:
    """For each row of ``a``, how many terms its product row sums: the symbolic half of the product."""
    terms = np.concatenate([[0], np.cumsum(np.diff(b.starts)[a.columns])])
    return terms[a.starts[1:]] - terms[a.starts[:-1]]


def product(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of ``a`` times ``b`` of ones, row by row.

    Each entry of a row of ``a`` picks a row of ``b``; the picked rows are merged, and how often a column
    was met is its value. Entries come by row, then by column.
    """
    sizes = np.diff(b.starts)[a.columns]
    met = b.columns[ranges(b.starts[a.columns], sizes)]
    rows = np.repeat(np.arange(len(a.starts) - 1, dtype=np.int64), partial_sizes(a, b))
    key, values = np.unique(rows * max(b.width, 1) + met, return_counts=True)
    return key // max(b.width, 1), key % max(b.width, 1), values


ship(__name__)
