"""Great-circle geometry: column expressions for Catalyst, and vantage-point trees over NumPy arrays for local joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth in metres.
RADIUS_M = 6_371_008.8
LEAF = 48


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two places in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(1.0) - a, F.lit(0.0))))


def usable_place(lat: Column, lon: Column) -> Column:
    """Whether the degrees are a location: both there, in range, not both 0."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def degrees(text: Column) -> Column:
    """The number that the text is, null for anything else, also for what only Java reads as a number."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def metres(lat1, lon1, lat2, lon2):
    """Great-circle metres between arrays of places in radians."""
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(1 - a, 0)))


def unit_vectors(lat, lon) -> np.ndarray:
    """Points on the unit sphere of places in radians, one a row."""
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


class VantageTree:
    """A vantage-point tree over places in radians; searches take many queries at once and are exact."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray) -> None:
        self.lat, self.lon = lat, lon
        self.nodes: list[tuple] = []
        if len(lat):
            self._build(np.arange(len(lat)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= LEAF:
            self.nodes[at] = (rows,)
            return at
        # the point farthest from the first one splits well
        far = rows[np.argmax(metres(self.lat[rows[0]], self.lon[rows[0]], self.lat[rows], self.lon[rows]))]
        d = metres(self.lat[far], self.lon[far], self.lat[rows], self.lon[rows])
        half = len(rows) // 2
        order = np.argpartition(d, half)
        near, rest = order[:half], order[half:]
        bounds = (d[near].min(), d[near].max(), d[rest].min(), d[rest].max())
        self.nodes[at] = (None, far, bounds, self._build(rows[near]), self._build(rows[rest]))
        return at

    def within(self, lat: np.ndarray, lon: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) indices of all pairs at most radius metres apart."""
        out_q, out_p = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        todo = [(0, np.arange(len(lat)))] if self.nodes else []
        while todo:
            at, q = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                rows = node[0]
                for s in range(0, len(q), 4096):
                    part = q[s : s + 4096]
                    hit = metres(lat[part, None], lon[part, None], self.lat[rows][None], self.lon[rows][None]) <= radius
                    i, j = np.nonzero(hit)
                    out_q.append(part[i])
                    out_p.append(rows[j])
                continue
            _, far, (a, b, c, e), near, rest = node
            d = metres(lat[q], lon[q], self.lat[far], self.lon[far])
            # a metre's thousandth covers rounding in the bounds; leaves decide exactly
            r = radius + 1e-3
            for child, low, high in ((near, a, b), (rest, c, e)):
                keep = q[(d + r >= low) & (d - r <= high)]
                if len(keep):
                    todo.append((child, keep))
        return np.concatenate(out_q), np.concatenate(out_p)

    def nearest(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, metres) of the nearest point of each query, equal distances to the smaller point; -1 and infinity without points."""
        point, far_m = np.full(len(lat), -1, np.int64), np.full(len(lat), np.inf)

        def visit(at: int, q: np.ndarray) -> None:
            node = self.nodes[at]
            if len(node) == 1:
                rows = np.sort(node[0])
                for s in range(0, len(q), 4096):
                    part = q[s : s + 4096]
                    d = metres(lat[part, None], lon[part, None], self.lat[rows][None], self.lon[rows][None])
                    k = d.argmin(axis=1)
                    m, p = d[np.arange(len(part)), k], rows[k]
                    better = (m < far_m[part]) | (m == far_m[part]) & (p < point[part])
                    point[part[better]], far_m[part[better]] = p[better], m[better]
                return
            _, far, (a, b, c, e), near, rest = node
            d = metres(lat[q], lon[q], self.lat[far], self.lon[far])
            first = d <= (b + c) / 2
            # the side a query lies on first, then the other as far as it may hold a nearer point
            for child, mine in ((near, first), (rest, ~first), (rest, first), (near, ~first)):
                low, high = (a, b) if child == near else (c, e)
                keep = mine & (d + far_m[q] + 1e-3 >= low) & (d - far_m[q] - 1e-3 <= high)
                if keep.any():
                    visit(child, q[keep])

        if self.nodes and len(lat):
            visit(0, np.nonzero(~(np.isnan(lat) | np.isnan(lon)))[0])
        return point, far_m


def _groups(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places (one row of each), and the rows in order of place with where each place starts."""
    _, first, inverse = np.unique(lat + 1j * lon, return_index=True, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    return first, order, np.searchsorted(inverse[order], np.arange(len(first) + 1)), inverse


def local_pairs(qlat, qlon, plat, plon, radius: float, chunk: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (query row, point row) of all pairs within radius; rows at one place are searched once and expanded at the end."""
    qlat, qlon, plat, plon = (np.radians(np.asarray(x, float)) for x in (qlat, qlon, plat, plon))
    qf, qo, qs, _ = _groups(qlat, qlon)
    pf, po, ps, _ = _groups(plat, plon)
    q, p = VantageTree(plat[pf], plon[pf]).within(qlat[qf], qlon[qf], radius)
    nq, np_ = np.diff(qs)[q], np.diff(ps)[p]
    total = np.concatenate([[0], np.cumsum(nq * np_)])
    for s in range(0, int(total[-1]), chunk):
        k = np.arange(s, min(s + chunk, int(total[-1])))
        pair = np.searchsorted(total, k, side="right") - 1
        rest = k - total[pair]
        yield qo[qs[q[pair]] + rest // np_[pair]], po[ps[p[pair]] + rest % np_[pair]]
