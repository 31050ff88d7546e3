"""Measures over whole columns of WKB: values of one shape, one ring or one path of as many points, are computed together.

Each function takes a list of WKB (or None) and gives an array of results and the positions it did not decide.
"""

from __future__ import annotations

import numpy as np

from tesselon.kernels import geometry, measures

_LINE, _RING = b"\x01\x02\x00\x00\x00", b"\x01\x03\x00\x00\x00\x01\x00\x00\x00"
_POLYGON, _MULTIPOLYGON = _RING[:5], b"\x01\x06\x00\x00\x00"
#: Pairs of boxes that are compared at once.
PAIRS = 1 << 22


def runs(values: list):
    """(positions, is a ring, coordinates of shape (values, points, 2)) of little-endian 2-D lines and polygons of one ring."""
    groups: dict[tuple[bool, int], list[int]] = {}
    for i, b in enumerate(values):
        if b is not None:
            if b[:9] == _RING and len(b) > 13:
                groups.setdefault((True, len(b)), []).append(i)
            elif b[:5] == _LINE and len(b) > 9:
                groups.setdefault((False, len(b)), []).append(i)
    for (ring, size), at in groups.items():
        head = 13 if ring else 9
        data = np.frombuffer(b"".join(bytes(values[i]) for i in at), np.uint8).reshape(len(at), size)
        points = data[:, head - 4 : head].copy().view("<u4").ravel()
        if (size - head) % 16 == 0 and (points == (size - head) // 16).all():
            yield np.array(at), ring, data[:, head:].copy().view("<f8").reshape(len(at), -1, 2)


def members(b: bytes) -> list[bytes] | None:
    """The polygons of a little-endian 2-D multipolygon as they stand in its bytes; None for anything else."""
    if b[:5] != _MULTIPOLYGON or len(b) < 9:
        return None
    count = int.from_bytes(b[5:9], "little")
    if count and (len(b) - 9) % count == 0 and (size := (len(b) - 9) // count) > 13 and (size - 13) % 16 == 0:
        head = np.frombuffer(b, np.uint8, offset=9).reshape(count, size)[:, :13]
        if (head == np.frombuffer(_RING + ((size - 13) // 16).to_bytes(4, "little"), np.uint8)).all():
            return [b[i : i + size] for i in range(9, len(b), size)]
    out, at = [], 9
    for _ in range(count):
        if b[at : at + 5] != _POLYGON:
            return None
        end = at + 9
        for _ in range(int.from_bytes(b[at + 5 : end], "little")):
            end += 4 + 16 * int.from_bytes(b[end : end + 4], "little")
            if end > len(b):
                return None
        out.append(b[at:end])
        at = end
    return out if at == len(b) else None


def clusters(boxes) -> np.ndarray:
    """A label for each row of (xmin, ymin, xmax, ymax): equal where a chain of boxes that meet leads from one to the other.

    Rows are parted by gaps in x and in y in turn until neither parts them further; boxes of what is left are compared.
    """
    boxes = np.asarray(boxes, float)
    label = np.arange(len(boxes))
    at = np.flatnonzero(np.isfinite(boxes).all(1))
    group, idle, axis = np.zeros(len(at), np.int64), 0, 0
    while len(at) and idle < 2:
        lo, hi = _ranks(boxes[at], axis)
        order = np.lexsort((lo, group))
        at, group, lo, hi = at[order], group[order], lo[order], hi[order]
        # Groups follow each other, so the greatest end so far is one of the own group.
        most = np.maximum.accumulate(group * (2 * len(at)) + hi)
        first = np.r_[True, group[1:] * (2 * len(at)) + lo[1:] > most[:-1]]
        parted = np.cumsum(first) - 1
        idle = idle + 1 if parted[-1] == group[-1] else 0
        many = np.bincount(parted)[parted] > 1
        at, group = at[many], np.unique(parted[many], return_inverse=True)[1]
        axis = 1 - axis
    if not len(at):
        return label
    spans = [_meetings(boxes[at], group, axis) for axis in (0, 1)]
    cost = np.stack([np.bincount(group[order], end - np.arange(len(at))) for order, end in spans])
    for axis, (order, end) in enumerate(spans):
        here = np.flatnonzero(cost.argmin(0)[group[order]] == axis)
        other = boxes[at[order]][:, [1 - axis, 3 - axis]]
        size = end[here] - here - 1
        done = 0
        while done < len(here):
            upto = max(done + 1, int(np.searchsorted(np.cumsum(size[done:]), PAIRS, "right")) + done)
            n = size[done:upto]
            i = np.repeat(here[done:upto], n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            meet = (other[i, 0] <= other[j, 1]) & (other[j, 0] <= other[i, 1])
            _join(label, at[order[i[meet]]], at[order[j[meet]]])
            done = upto
    return label


def _ranks(boxes, axis: int):
    """Ends of the boxes on an axis as ranks among all of them."""
    n = len(boxes)
    ranks = np.unique(np.concatenate([boxes[:, axis], boxes[:, axis + 2]]), return_inverse=True)[1]
    return ranks[:n], ranks[n:]


def _meetings(boxes, group, axis: int):
    """An order by group and lower end, and for each place in it the place before which those stand that begin where it reaches."""
    lo, hi = _ranks(boxes, axis)
    base = group * (2 * len(boxes))
    order = np.argsort(base + lo, kind="stable")
    return order, np.searchsorted((base + lo)[order], (base + hi)[order], "right")


def _join(label, i, j) -> None:
    """Gives the least label to what pairs connect."""
    while len(i):
        a, b = label[i], label[j]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]


def _decided(values: list, one):
    out = np.full(len(values), np.nan)
    left = np.array([v is not None for v in values], bool)
    for at, ring, xy in runs(values):
        found, sound = one(ring, xy)
        out[at], left[at] = found, ~sound
    return out, np.flatnonzero(left)


def _cross(xy):
    """Twice the signed area of the triangle of each edge with the first vertex."""
    r = xy - xy[:, :1]
    return r[:, :-1, 0] * r[:, 1:, 1] - r[:, 1:, 0] * r[:, :-1, 1]


def area(values: list):
    """Those of multipolygons as the sum over their polygons."""
    out, left = _simple_areas(values)
    rest = []
    for i in left.tolist():
        items = members(bytes(values[i]))
        if items is None:
            rest.append(i)
            continue
        each, holed = _simple_areas(items)
        for k in holed.tolist():
            each[k] = measures.area(geometry.from_wkb(items[k]))
        out[i] = each.sum()
    return out, np.array(rest, int)


def _simple_areas(values: list):
    return _decided(values, lambda ring, xy: (np.abs(_cross(xy).sum(1)) / 2 if ring else np.zeros(len(xy)), np.isfinite(xy).all((1, 2))))


def length(values: list):
    return _decided(values, lambda ring, xy: (np.hypot(*np.moveaxis(np.diff(xy, axis=1), 2, 0)).sum(1), np.isfinite(xy).all((1, 2))))


def centroid(values: list):
    """x, y, and the positions not decided: those without area or length among them."""
    x, y = np.full(len(values), np.nan), np.full(len(values), np.nan)
    left = np.array([v is not None for v in values], bool)
    for at, ring, xy in runs(values):
        a, b = xy[:, :-1], xy[:, 1:]
        if ring:
            w = _cross(xy)[:, :, None]
            middle = (a + b - 2 * xy[:, :1]) / 3
        else:
            w = np.hypot(*np.moveaxis(b - a, 2, 0))[:, :, None]
            middle = (a + b) / 2 - xy[:, :1]
        total = w.sum(1)
        sound = (total[:, 0] != 0) & np.isfinite(xy).all((1, 2))
        mid = xy[:, 0] + (w * middle).sum(1) / np.where(total == 0, 1.0, total)
        x[at], y[at], left[at] = mid[:, 0], mid[:, 1], ~sound
    return x, y, np.flatnonzero(left)


def inset(values: list, r: float):
    """The points at least ``r`` inside convex polygons of one ring: WKB and boxes by position, and the positions not decided.

    Of a convex polygon these are the points on the inner side of every edge moved in by ``r``.  Where every edge keeps its
    direction they have the moved edges as their boundary, else the polygon is clipped by them one by one.  What rounding
    could decide is left.
    """
    out: dict[int, tuple] = {}
    for at, ring, xy in runs(values):
        if not ring or xy.shape[1] < 4:
            continue
        ok = np.isfinite(xy).all((1, 2)) & (xy[:, 0] == xy[:, -1]).all(1)
        at, v = at[ok], xy[ok, :-1] + 0.0
        cw = _cross(xy[ok]).sum(1) < 0
        v[cw] = v[cw, ::-1]
        edge = np.roll(v, -1, 1) - v
        size = np.hypot(edge[..., 0], edge[..., 1])
        ok = (size > 0).all(1)
        at, v, edge, size = at[ok], v[ok], edge[ok], size[ok]
        u = edge / size[..., None]
        before = np.roll(u, 1, 1)
        cross, dot = before[..., 0] * u[..., 1] - before[..., 1] * u[..., 0], (before * u).sum(2)
        # Left turns only, by one full turn in all, and no spikes.
        ok = (cross > 1e-9).all(1) & (np.arctan2(cross, dot).sum(1) < 7) & (dot > -1 + 1e-6).all(1)
        at, v, u, before, dot = at[ok], v[ok], u[ok], before[ok], dot[ok]
        normal = np.stack([-u[..., 1], u[..., 0]], 2)
        p = v + r * (normal + np.roll(normal, 1, 1)) / (1 + dot)[..., None] + 0.0
        tol = 1e-9 * np.maximum(np.abs(v).max((1, 2)), r)
        kept = (((np.roll(p, -1, 1) - p) * u).sum(2) > tol[:, None]).all(1)
        for i in np.flatnonzero(~kept).tolist():
            path = _clipped(v[i], normal[i], r, tol[i])
            if path is not None:
                out[int(at[i])] = _ring_row(path)
        at, p = at[kept], p[kept]
        k = p.shape[1] + 1
        rec = np.empty(len(at), np.dtype([("head", "V9"), ("n", "<u4"), ("c", "<f8", (k, 2))]))
        rec["head"], rec["n"], rec["c"][:, :-1], rec["c"][:, -1] = np.void(_RING), k, p, p[:, 0]
        data, step = rec.tobytes(), rec.dtype.itemsize
        boxes = np.concatenate([p.min(1), p.max(1)], 1).tolist() if len(p) else []
        for n, (i, b) in enumerate(zip(at.tolist(), boxes)):
            out[i] = (data[n * step : (n + 1) * step], *b)
    return out, [i for i, b in enumerate(values) if b is not None and i not in out]


def _clipped(v, normal, r: float, tol: float):
    """A convex ring without the strips of width ``r`` along its edges; None if too thin to tell."""
    path = v.tolist()
    for (x, y), (nx, ny) in zip(v.tolist(), normal.tolist()):
        side = [(p[0] - x) * nx + (p[1] - y) * ny - r for p in path]
        if max(side) < -tol:
            return []
        if max(side) <= tol:
            return None
        cut = []
        for p, q, s, t in zip(path, path[1:] + path[:1], side, side[1:] + side[:1]):
            if s >= 0:
                cut.append(p)
            if (s > 0 > t) or (s < 0 < t):
                f = s / (s - t)
                cut.append([p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])])
        path = cut
    # Corners that fell together are one.
    path = [p for k, p in enumerate(path) if max(abs(p[0] - path[k - 1][0]), abs(p[1] - path[k - 1][1])) > tol]
    return path if len(path) >= 3 else None


def _ring_row(path: list) -> tuple:
    if not path:
        return (b"\x01\x03\x00\x00\x00\x00\x00\x00\x00", *(None,) * 4)
    c = np.array([*path, path[0]], "<f8") + 0.0
    return (_RING + np.uint32(len(c)).astype("<u4").tobytes() + c.tobytes(), *c.min(0).tolist(), *c.max(0).tolist())
