"""Geospatial vector analytics expressed as Spark plans."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.1.0"

_WHERE = {
    "GeoFrame": "operators.frame", "GeoSeries": "operators.frame", "points_from_xy": "operators.frame", "boxes_from_bounds": "operators.frame",
    "from_wkt": "operators.frame", "from_wkb": "operators.frame", "from_df": "operators.frame", "from_local": "operators.frame", "concat": "operators.frame",
    "clip": "operators.select", "sjoin": "operators.sjoin", "sjoin_nearest": "operators.sjoin", "dissolve": "operators.aggregate", "union_all": "operators.aggregate",
    "spatial_shuffle": "operators.partition", "read_parquet": "sources.geoparquet", "to_parquet": "sources.geoparquet",
    "read_feather": "sources.geofeather", "to_feather": "sources.geofeather", "read_file": "sources.vector",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"tesselon.{_WHERE[name]}"), name)
