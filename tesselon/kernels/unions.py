"""Union of many geometries as WKB: parts whose box meets no other stay the bytes they are, the rest goes to the arrangements."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable
from itertools import pairwise

import numpy as np

from tesselon.kernels import columns as K
from tesselon.kernels import geometry as G
from tesselon.kernels import topology as T

#: Bytes up to which geometries are united one by one, as arrays do not pay.
SMALL = 1 << 14


def at_once(geoms: Iterable[G.Geom]) -> G.Geom:
    return T.union_all(list(geoms))


def parts(values: Iterable[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The simple geometries that values hold, little-endian, and their boxes; empty ones left out."""
    items: list[bytes] = []
    for b in values:
        items += K.members(b) or [b]
    boxes = np.full((len(items), 4), np.nan)
    left = np.ones(len(items), bool)
    for at, _, xy in K.runs(items):
        boxes[at, :2], boxes[at, 2:], left[at] = xy.min(1), xy.max(1), False
    if left.any():
        at = np.flatnonzero(left).tolist()
        more = [(i, p) for i in at for p in G.from_wkb(items[i]).parts()]
        kept = np.flatnonzero(~left)
        order = np.argsort(np.r_[kept, np.array([i for i, _ in more], np.int64)], kind="stable")
        items = [items[i] for i in kept.tolist()] + [G.to_wkb(p) for _, p in more]
        items = [items[i] for i in order.tolist()]
        boxes = np.concatenate([boxes[kept], np.array([p.bounds() for _, p in more], float).reshape(-1, 4)])[order]
    return items, boxes


def _codes(items: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([b[1:3] for b in items]), "<u2").astype(np.int64)


def united(values: list[bytes], cluster: Callable[[Iterable[G.Geom]], G.Geom] = at_once) -> tuple[list[bytes], np.ndarray]:
    """The parts of the union in their order, and their boxes; ``cluster`` unites geometries whose boxes meet in a chain."""
    items, boxes = parts(values)
    if not items:
        return items, boxes
    label = K.clusters(boxes)
    codes = _codes(items)
    alone = (np.bincount(label, minlength=len(items))[label] == 1) & (codes % 1000 != G.LINE)
    meet = np.flatnonzero(~alone)
    meet = meet[np.argsort(label[meet], kind="stable")]
    made = []
    for rows in np.split(meet, np.flatnonzero(np.diff(label[meet])) + 1) if len(meet) else ():
        made += cluster(G.from_wkb(items[i]) for i in rows.tolist()).parts()
    if made:
        items = [items[i] for i in np.flatnonzero(alone).tolist()] + [G.to_wkb(p) for p in made]
        boxes = np.concatenate([boxes[alone], np.array([p.bounds() for p in made], float)])
    order = np.lexsort((boxes[:, 3], boxes[:, 2], boxes[:, 1], boxes[:, 0], -(_codes(items) % 1000)))
    return [items[i] for i in order.tolist()], boxes[order]


def collected(items: list[bytes]) -> bytes:
    """``geometry.collect`` of parts as WKB."""
    if len(items) < 2:
        return items[0] if items else G.to_wkb(G.EMPTY)
    codes = _codes(items)
    kind = int(codes[0]) % 1000 + 3 if (codes % 1000 == codes[0] % 1000).all() else G.COLLECTION
    return struct.pack("<BII", 1, kind + (1000 if (codes >= 1000).any() else 0), len(items)) + b"".join(items)


def unite(values: list[bytes], cluster: Callable[[Iterable[G.Geom]], G.Geom] = at_once) -> tuple:
    """WKB and box of the union."""
    if sum(map(len, values)) <= SMALL:
        g = cluster(map(G.from_wkb, values))
        return (G.to_wkb(g), *(g.bounds() or (None,) * 4))
    items, boxes = united(values, cluster)
    return (collected(items), *_box(boxes))


def boxed(b: bytes) -> tuple:
    """A geometry as it is, with its box."""
    return (b, *((G.from_wkb(b).bounds() or (None,) * 4) if len(b) <= SMALL else _box(parts([b])[1])))


def pieces(values: list[bytes], size: int, cluster: Callable[[Iterable[G.Geom]], G.Geom] = at_once) -> list[bytes]:
    """The union as geometries of about ``size`` bytes, or of one part."""
    if sum(map(len, values)) <= min(SMALL, size):
        return [G.to_wkb(cluster(map(G.from_wkb, values)))]
    items, _ = united(values, cluster)
    at = np.cumsum([len(b) for b in items]) // size
    return [collected(items[i:j]) for i, j in pairwise([0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(items)])]


def _box(boxes: np.ndarray) -> tuple:
    return (*boxes[:, :2].min(0).tolist(), *boxes[:, 2:].max(0).tolist()) if len(boxes) else (None,) * 4
