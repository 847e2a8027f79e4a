"""Sources behind requests: pages, retries, pacing, boxes that split. The transport is a callable, so nothing here opens a connection.

A transport takes an address and gives (status, headers, body). Large sets of addresses are rows that ``fetch_all`` reads
partition by partition; the rest is what one reader does.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

Transport = Callable[[str], tuple[int, dict[str, str], str]]

#: Seconds between requests, rows of a page, retries and first delay of JSON, retries and delays of maps, splits, margins.
PACE_S, PAGE_ROWS, JSON_RETRIES, JSON_DELAY_S, MAP_RETRIES, MAP_DELAYS_S, SPLITS, TRIES, LEAST_MARGIN = 1.2, 500, 4, 1.0, 2, (5.0, 15.0), 6, 6, 0.001
#: How a service says that there are too many nodes or requests, and how long to wait.
TOO_MANY = re.compile(r"too many nodes", re.I)
LIMITED = re.compile(r"(downloaded too much data|rate limit|quota exceeded|too many requests|bandwidth limit exceeded|please wait)", re.I)
LIMITED_STATUS = frozenset((429, 509))
WAIT = re.compile(r"(?:please\s+)?wait\s+(\d+)\s*(second|minute|hour)", re.I)
UNITS = {"second": 1, "minute": 60, "hour": 3600}


class TooManyNodes(Exception):
    """A box holds more than the service gives."""


class RequestFailed(Exception):
    """A request that is not tried again."""

    def __init__(self, status: int, body: str):
        super().__init__(f"request failed with {status}: {body}")
        self.status, self.body = status, body


@dataclass
class Pace:
    """Slots at least ``seconds`` apart."""

    seconds: float = PACE_S
    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    next_at: float = field(default=float("-inf"))

    def wait(self) -> float:
        at = self.now()
        pause = max(0.0, self.next_at - at)
        self.next_at = max(self.next_at, at) + self.seconds
        if pause:
            self.sleep(pause)
        return pause


def read_json(get: Transport, url: str, retries: int = JSON_RETRIES, delay: float = JSON_DELAY_S, sleep: Callable[[float], None] = time.sleep):
    """A JSON document; where the service is busy or fails, tried again after delays that double."""
    for attempt in range(retries + 1):
        status, _, body = get(url)
        if 200 <= status < 300:
            return json.loads(body)
        if attempt == retries or status != 429 and status < 500:
            raise RequestFailed(status, body)
        sleep(delay * 2**attempt)


def paged(page: Callable[[int, int], list], size: int = PAGE_ROWS) -> Iterator:
    """Rows of all pages (offset, size), up to the first short one."""
    at = 0
    while True:
        rows = page(at, size)
        yield from rows
        if len(rows) < size:
            return
        at += size


def delay_of(headers: dict[str, str], body: str, attempt: int, fallback: tuple[float, ...] = MAP_DELAYS_S) -> float:
    """Seconds to wait: as the header says, else as the text says, else by the attempt."""
    said = next((v for k, v in headers.items() if k.lower() == "retry-after"), "")
    try:
        if said and 0 <= float(said) < float("inf"):
            return round(float(said), 3)
    except ValueError:
        pass
    m = WAIT.search(body)
    return float(m[1]) * UNITS[m[2].lower()] if m else fallback[min(attempt, len(fallback) - 1)]


def read_map(get: Transport, url: str, pace: Pace, retries: int = MAP_RETRIES) -> str:
    """A map extract, paced and tried again where the service limits requests."""
    for attempt in range(retries + 1):
        pace.wait()
        status, headers, body = get(url)
        if 200 <= status < 300:
            return body
        if status not in LIMITED_STATUS and not LIMITED.search(body):
            raise TooManyNodes(url) if TOO_MANY.search(body) else RequestFailed(status, body.strip())
        if attempt == retries:
            raise RequestFailed(status, f"limited after {retries + 1} attempts: {body.strip()}")
        pace.sleep(delay_of(headers, body, attempt))
    raise AssertionError


def read_or_none(get: Transport, url: str, pace: Pace) -> str | None:
    """An extract, or nothing where the service does not give it (limits still raise)."""
    try:
        return read_map(get, url, pace)
    except TooManyNodes:
        return None
    except RequestFailed as failed:
        if failed.status in LIMITED_STATUS or LIMITED.search(failed.body):
            raise
        return None


Box = tuple[float, float, float, float]


def quarters(box: Box) -> list[Box]:
    """South-west, south-east, north-west, north-east of (south, west, north, east)."""
    s, w, n, e = box
    y, x = (s + n) / 2, (w + e) / 2
    return [(s, w, y, x), (s, x, y, e), (y, w, n, x), (y, x, n, e)]


def read_box(read: Callable[[Box], str], box: Box, splits: int = SPLITS) -> list[str]:
    """Extracts that cover a box: itself, or its quarters' where it holds too many nodes."""
    try:
        return [read(box)]
    except TooManyNodes:
        if splits == 0:
            raise
        return [x for q in quarters(box) for x in read_box(read, q, splits - 1)]


def read_around(read: Callable[[float], str], margin: float, least: float = LEAST_MARGIN, tries: int = TRIES) -> str:
    """An extract with a margin that is halved while it holds too many nodes."""
    for _ in range(tries):
        try:
            return read(margin)
        except TooManyNodes:
            if margin <= least:
                raise
            margin = max(least, margin / 2)
    raise TooManyNodes("too dense at the least margin")


def around(lat: float, lon: float, margin: float) -> Box:
    if not all(abs(v) < float("inf") for v in (lat, lon)):
        raise ValueError("coordinates must be finite")
    if not 0 < margin < float("inf"):
        raise ValueError("margin must be a positive number")
    return lat - margin, lon - margin, lat + margin, lon + margin


def fetch_all(urls: DataFrame, transport: Callable[[], Transport]) -> DataFrame:
    """(key, url) -> (key, status, body): each partition makes its transport and keeps the pace. Failures are rows, with their status."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, pace = transport(), Pace()
        for frame in frames:
            out = []
            for key, url in zip(frame["key"], frame["url"]):
                try:
                    out.append((key, 200, read_map(get, url, pace)))
                except RequestFailed as failed:
                    out.append((key, failed.status, None))
                except TooManyNodes:
                    out.append((key, 400, None))
            yield pd.DataFrame(out, columns=["key", "status", "body"])

    return urls.select("key", "url").mapInPandas(run, f"key {urls.schema['key'].dataType.simpleString()}, status int, body string")


def pixels_of(tiles: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions (.., z, tx, ty, px, py) with the colours of their pixel; tiles (z, tx, ty, rgba binary of 256 x 256).

    An equi-join on the tile; a position whose tile is not there has null colours.
    """
    from pyspark.sql import functions as F

    hit = positions.join(tiles.select("z", "tx", "ty", "rgba"), ["z", "tx", "ty"], "left")
    byte = lambda i: F.conv(F.hex(F.substring("rgba", ((F.col("py") * 256 + F.col("px")) * 4 + 1 + i).cast("int"), F.lit(1))), 16, 10).cast("int")
    return hit.withColumns({"r": byte(0), "g": byte(1), "b": byte(2)}).drop("rgba")
