"""Banded alignment of many pairs of number sequences at once."""

from __future__ import annotations

import numpy as np

_PAD_A, _PAD_B = np.int64(-1), np.int64(-2)


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Edit distance within ``width`` diagonals of the main one; an upper bound of the distance.

    Row i of the table, for all pairs together, holds the cells
    (i, i - width) to (i, i + width).
    """
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    rows, span, count = int(n.max()), 2 * width + 1, len(pairs)
    big = np.int32(1 << 28)
    left = np.full((count, rows), _PAD_A)
    right = np.full((count, rows + span), _PAD_B)  # right[:, width + j] is b[j]
    for k, (a, b) in enumerate(pairs):
        left[k, : len(a)] = a
        some = b[: rows + width + 1]
        right[k, width : width + len(some)] = some
    offset = np.arange(span, dtype=np.int32)
    row = np.where(offset >= width, offset - width, big).astype(np.int32)[None, :].repeat(count, 0)  # row 0: j = offset - width
    result = np.full(count, big)

    def pick(i: int) -> None:
        at = np.flatnonzero(n == i)
        place = m[at] - i + width
        ok = (place >= 0) & (place < span)
        result[at[ok]] = row[at[ok], place[ok]]

    pick(0)
    for i in range(1, rows + 1):
        step = row + (right[:, i - 1 : i - 1 + span] != left[:, i - 1 : i])
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        low = width - i  # the cell with j = 0
        if low >= 0:
            step[:, low] = i
            step[:, :low] = big
        row = np.minimum.accumulate(step - offset, axis=1) + offset
        row = np.minimum(row, big)
        if (n == i).any():
            pick(i)
    return result


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the common start and the common end."""
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    start = int(differ[0]) if len(differ) else short
    a, b = a[start:], b[start:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    end = int(differ[0]) if len(differ) else short
    return a[: len(a) - end], b[: len(b) - end]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common multiset; no alignment matches more."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(nx[i], ny[j]).sum())


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], least: float, cells: int = 4_000_000) -> np.ndarray:
    """Whether 1 - edit distance / longer length is at least ``least``, for every pair.

    A pair is settled exactly: a band as wide as the allowed distance decides,
    narrower ones are tried first since they can only confirm. Pairs of like
    length are aligned together, at most ``cells`` table cells at a time.
    """
    out = np.zeros(len(pairs), bool)
    open_: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for k, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        allowed = int(np.floor(longer * (1 - least) + 1e-9))
        if abs(len(a) - len(b)) > allowed:
            continue
        a, b = _trimmed(a, b)
        if max(len(a), len(b)) <= allowed:
            out[k] = True
        elif max(len(a), len(b)) - _common(a, b) <= allowed:
            open_.append((k, allowed, a.astype(np.int64), b.astype(np.int64)))
    width = 8
    while open_:
        open_.sort(key=lambda x: len(x[2]))
        later = []
        at = 0
        while at < len(open_):
            end, rows = at, 0
            while end < len(open_) and (end == at or (end + 1 - at) * (2 * width + 1 + max(rows, len(open_[end][2]))) <= cells // 16):
                rows = max(rows, len(open_[end][2]))
                end += 1
            some = open_[at:end]
            found = _banded([(a, b) for _, _, a, b in some], width)
            for (k, allowed, a, b), distance in zip(some, found.tolist()):
                if distance <= allowed:
                    out[k] = True
                elif width < allowed:
                    later.append((k, allowed, a, b))
            at = end
        open_, width = later, width * 4
    return out
