"""DuckDB SQL that several modules of queries share."""

from .queries import _SEG as SEGMENTS  # noqa: F401


def METRES_RAW(x1: str, y1: str, x2: str, y2: str) -> str:  # noqa: N802
    """Great-circle metres between two points in micro-degrees, not rounded."""
    lat, lon = (lambda v: f"radians(32.80::DOUBLE + ({v}) / 1e6)"), (lambda v: f"radians(-83.70::DOUBLE + ({v}) / 1e6)")
    s, t = f"sin(({lat(y2)} - {lat(y1)}) / 2)", f"sin(({lon(x2)} - {lon(x1)}) / 2)"
    return f"(12742017.6::DOUBLE * asin(sqrt({s} * {s} + cos({lat(y1)}) * cos({lat(y2)}) * {t} * {t})))"
