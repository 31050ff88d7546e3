"""Selection by box and clipping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.functions import st
from tesselon.kernels import geometry as G
from tesselon.kernels import topology as T
from tesselon.operators.frame import BOX, GeoFrame, box_name


def _overlap(box, b):
    return (box["xmin"] <= b[2]) & (box["xmax"] >= b[0]) & (box["ymin"] <= b[3]) & (box["ymax"] >= b[1])


def _inside(box, b):
    return (box["xmin"] >= b[0]) & (box["xmax"] <= b[2]) & (box["ymin"] >= b[1]) & (box["ymax"] <= b[3])


class BoxIndexer:
    """``frame.cx[xmin:xmax, ymin:ymax]``: rows whose geometry intersects the box; open ends are unbounded."""

    def __init__(self, frame: GeoFrame):
        self.frame = frame

    def __getitem__(self, key) -> GeoFrame:
        xs, ys = (k if isinstance(k, slice) else slice(k, k) for k in key)
        if xs.step is not None or ys.step is not None:
            raise ValueError("a step makes no sense in a box")
        inf = float("inf")
        lo = lambda s: -inf if s.start is None else float(s.start)
        hi = lambda s: inf if s.stop is None else float(s.stop)
        b = (min(lo(xs), hi(xs)), min(lo(ys), hi(ys)), max(lo(xs), hi(xs)), max(lo(ys), hi(ys)))
        f = self.frame.within_reach([b])
        # Conjuncts on the companion reach the files' statistics; only boxes across the edge need the kernel.
        near = f.df.filter(_overlap(f.bbox, b))
        if f.meta.get("types") in (["Point"], ["Box"]):
            return f._on(near, True)
        finite = [max(-1e300, min(1e300, v)) for v in b]
        hits = st.scalar(lambda g, window: _meets(g, window), "boolean", False)(f.geometry, window=finite)
        return f._on(near.filter(_inside(f.bbox, b) | hits), True)


def _meets(g: G.Geom, window) -> bool:
    b = g.bounds()
    w = [max(window[0], b[0] - 1), max(window[1], b[1] - 1), min(window[2], b[2] + 1), min(window[3], b[3] + 1)]
    if w[0] > w[2] or w[1] > w[3]:
        return False
    if w[0] == w[2] and w[1] == w[3]:
        mask = G.point(w[0], w[1])
    elif w[0] == w[2] or w[1] == w[3]:
        mask = G.line([w[:2], w[2:]])
    else:
        mask = G.box(*w)
    return T.predicate("intersects", g, mask)


def clip(frame: GeoFrame, mask, keep_geom_type: bool = False) -> GeoFrame:
    """Rows that meet the mask, each cut to it; ``keep_geom_type`` drops what has a lower dimension than it had."""
    if isinstance(mask, GeoFrame):
        raise NotImplementedError("the mask must be a geometry or a local list of them")
    g = T.union_all([G.as_geom(m) for m in mask]) if isinstance(mask, (list, tuple)) else G.as_geom(mask)
    b = g.bounds()
    if b is None:
        return frame.filter(F.lit(False))
    from tesselon.operators.frame import is_box

    frame = frame.within_reach([b])
    near = frame.df.filter(_overlap(frame.bbox, b))
    wkb = G.to_wkb(g)

    def cut(x, mask_wkb, keep, box_only):
        m = _mask(mask_wkb)
        if box_only:
            p, q = x.bounds(), m.bounds()
            if q[0] <= p[0] and q[1] <= p[1] and p[2] <= q[2] and p[3] <= q[3]:
                return x
        out = T.overlay("intersection", x, m)
        if keep:
            out = G.collect([p for p in out.parts() if p.kind - 1 == x.dimension()])
        return None if out.is_empty else out

    if frame.meta.get("types") == ["Point"] and is_box(g):
        return frame._on(near)
    built = st.builder(cut)(frame.geometry, mask_wkb=wkb, keep=keep_geom_type, box_only=is_box(g))
    out = GeoFrame._built(near, frame.name, built, {"crs": frame.crs})
    return GeoFrame(out.df.filter(F.col(f"`{box_name(frame.name)}`").isNotNull()), frame.name)


_masks: dict[bytes, G.Geom] = {}


def _mask(wkb: bytes) -> G.Geom:
    if wkb not in _masks:
        _masks.clear()
        _masks[wkb] = G.from_wkb(wkb)
    return _masks[wkb]


__all__ = ["BOX", "BoxIndexer", "clip"]
