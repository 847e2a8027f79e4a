"""Column functions on positions: projection, distance, tiles, keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Metres of a degree, tile size, latitude bound, zoom, blend.
METRES, TILE, MAX_LAT, ZOOM, BLEND = 111_320.0, 256, 85.05112878, 13, 0.35


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the flat around the mean latitude."""
    dx = (lon2 - lon1) * METRES * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * METRES
    return F.sqrt(dx * dx + dy * dy)


def project(lat: Column, lon: Column, chain: str) -> tuple[Column, Column]:
    """(x, y) in metres about the chain's mean position."""
    w = Window.partitionBy(chain)
    lat0, lon0 = F.avg(lat).over(w), F.avg(lon).over(w)
    return (lon - lon0) * METRES * F.cos(F.radians(lat0)), (lat - lat0) * METRES


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def tile(lat: Column, lon: Column, zoom: int = ZOOM) -> tuple[Column, Column, Column, Column]:
    """(tile x, tile y, pixel x, pixel y) of a position."""
    n = float(1 << zoom)
    lat = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)))
    fx = (wrap_lon(lon) + 180) / 360 * n
    fy = (1 - F.ln(F.tan(lat) + 1 / F.cos(lat)) / math.pi) / 2 * n
    cap = lambda v, top: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(int(top))).cast("long")
    tx, ty = cap(fx, n - 1), cap(fy, n - 1)
    return tx, ty, cap((fx - tx) * TILE, TILE - 1), cap((fy - ty) * TILE, TILE - 1)


def tile_height(r: Column, g: Column, b: Column) -> Column:
    """Metres coded in a pixel's colours."""
    return r * 256 + g + b / 256 - 32768


def snap_key(x: Column, cell: float) -> Column:
    return F.floor(x / cell + 0.5).cast("long")


def smooth(value: Column, w_chain: Window, w_order: Window, blend: float = BLEND) -> Column:
    """Three-point smoothing round a closed series; series under three points stay."""
    whole = w_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag(value).over(w_order), F.last(value).over(whole))
    after = F.coalesce(F.lead(value).over(w_order), F.first(value).over(whole))
    return F.when(F.count("*").over(w_chain) < 3, value).otherwise(value + ((before + 2 * value + after) / 4 - value) * blend)


def exaggerate(value: Column, w_chain: Window, factor: float) -> Column:
    """Heights over the least one, scaled; a factor of 0 is flat at 1."""
    return F.lit(1.0) if factor == 0 else (value - F.min(value).over(w_chain)) * factor
