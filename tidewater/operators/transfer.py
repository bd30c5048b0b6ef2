"""Transfer functions of ordered first-come requests (used by ``reserve``).

A run of requests is a map from the stock before it to the stock after it. A request q turns a stock s >= q into s - q
and leaves any other: the map is piecewise a shift. ``transfer`` builds it over a domain of starting stocks. Most
requests touch no piece: below all current stocks a request shifts them all, above all it changes none, and both cost
one comparison. Only a request between them cuts pieces; each such cut narrows the range of current stocks, so cuts
become rare as the run goes on.
"""

from __future__ import annotations

import numpy as np

INTERVALS = 64   # of an image that is handed on; nearest ones are joined beyond it, which only widens it


def transfer(quantities: list[int], domain: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(lo, hi, shift) pieces, by lo: starting stocks lo to hi end at themselves plus shift. Covers ``domain``
    (disjoint intervals, ends included)."""
    lo, hi = (np.array(x, np.int64) for x in zip(*sorted(domain)))
    shift = np.zeros(len(lo), np.int64)
    moved, least, most, compact_at = 0, int(lo.min()), int(hi.max()), 1024
    for q in quantities:
        at = q - moved                       # in the stocks before the common shift ``moved``
        if at <= least:
            moved -= q
        elif at <= most:
            now_lo, now_hi = lo + shift, hi + shift
            cut = (now_lo < at) & (now_hi >= at)
            edge = at - shift[cut]
            lo, shift = np.concatenate((lo, edge)), np.concatenate((shift, shift[cut]))
            hi = np.concatenate((np.where(cut, at - 1 - shift[:len(cut)], hi), hi[cut]))
            shift[lo + shift >= at] -= q
            least, most = int((lo + shift).min()), int((hi + shift).max())
            if len(lo) > compact_at:
                lo, hi, shift = _joined(lo, hi, shift)
                compact_at = 2 * len(lo) + 1024
    lo, hi, shift = _joined(lo, hi, shift)
    return list(zip(lo.tolist(), hi.tolist(), (shift + moved).tolist()))


def _joined(lo: np.ndarray, hi: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces by lo, neighbours with the same shift joined."""
    order = np.argsort(lo)
    lo, hi, shift = lo[order], hi[order], shift[order]
    new = np.ones(len(lo), bool)
    new[1:] = (shift[1:] != shift[:-1]) | (lo[1:] != hi[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return lo[first], hi[last], shift[first]


def image(pieces: list[tuple[int, int, int]], most: int = INTERVALS) -> list[tuple[int, int]]:
    """The stocks that the pieces end at, as at most ``most`` disjoint intervals (a superset if there are more)."""
    out: list[list[int]] = []
    for lo, hi in sorted((lo + shift, hi + shift) for lo, hi, shift in pieces):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    if len(out) > most:
        gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1], reverse=True)
        cuts = [0, *sorted(gaps[:most - 1]), len(out)]
        out = [[out[a][0], out[b - 1][1]] for a, b in zip(cuts, cuts[1:])]
    return [(lo, hi) for lo, hi in out]
