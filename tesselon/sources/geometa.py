"""The ``geo`` metadata of columnar files."""

from __future__ import annotations

import json

from tesselon.functions import crs as C
from tesselon.operators.frame import GeoFrame, box_name, geometry_columns

VERSION = "1.1.0"


def describe(frame: GeoFrame, covering: bool = True) -> dict:
    """Per-column metadata without the boxes, which each file has of its own."""
    columns = {}
    for g in geometry_columns(frame.df):
        meta = frame.df.schema[g].metadata["geo"]
        c = {"encoding": "WKB", "geometry_types": [], "crs": meta.get("crs")}
        if covering:
            c["covering"] = {"bbox": {k: [box_name(g), k] for k in ("xmin", "ymin", "xmax", "ymax")}}
        columns[g] = c
    return {"version": VERSION, "primary_column": frame.name, "columns": columns}


class Boxes:
    """Collects the boxes of one file's rows and gives its JSON."""

    def __init__(self, geo: dict):
        self.geo = geo
        self.found: dict[str, list] = {}

    def add(self, batch) -> None:
        import pyarrow.compute as pc

        for g in self.geo["columns"]:
            box = batch.column(batch.schema.get_field_index(box_name(g)))
            v = [f(pc.struct_field(box, k)).as_py() for k, f in (("xmin", pc.min), ("ymin", pc.min), ("xmax", pc.max), ("ymax", pc.max))]
            if None not in v:
                o = self.found.get(g, v)
                self.found[g] = [min(o[0], v[0]), min(o[1], v[1]), max(o[2], v[2]), max(o[3], v[3])]

    def text(self) -> str:
        columns = {g: c | ({"bbox": self.found[g]} if g in self.found else {}) for g, c in self.geo["columns"].items()}
        return json.dumps(self.geo | {"columns": columns})


def read(metadata: dict | None) -> dict:
    if not metadata or b"geo" not in metadata:
        raise ValueError("Missing geo metadata: the file has no 'geo' key")
    return json.loads(metadata[b"geo"])


def crs_of(column: dict) -> str | None:
    """An absent CRS is OGC:CRS84, an explicit null stays undefined."""
    return C.name_of(column["crs"]) if "crs" in column else "OGC:CRS84"


def box_of(column: dict) -> tuple[float, float, float, float] | None:
    b = column.get("bbox")
    if not b or any(v is None or v != v for v in b):
        return None
    return tuple(b) if len(b) == 4 else (b[0], b[1], b[3], b[4])
