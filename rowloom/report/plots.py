"""Plots: their data as data frames, then drawn as SVG, or as PNG by a small raster writer."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from rowloom.operators.summary import statistic
from rowloom.operators.tables import plain
from rowloom.plans.dataset import Dataset

WIDTH, HEIGHT, EDGE = 640, 480, 50
#: Points of a scatter plot; beyond it, points are counted in as many cells of a grid.
CELLS = 200


def bars(ds: Dataset, category: str, response: str | None = None, stat: str = "sum") -> Dataset:
    value = statistic(stat, response) if response else F.count("*").cast("double")
    return plain(ds.df.groupBy(category).agg(value.alias("value")), [category])


def histogram(ds: Dataset, var: str, bins: int = 10) -> Dataset:
    low, high = ds.df.agg(F.min(var), F.max(var)).head()
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(var) - low) / width), F.lit(bins - 1))
    return plain(ds.df.where(F.col(var).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").cast("double").alias("count")).select(F.col("bin").cast("double").alias("bin"), (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "count"), ["bin"])


def boxes(ds: Dataset, var: str, category: str | None = None) -> Dataset:
    keys = [category] if category else []
    q = [F.percentile(var, p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return plain(ds.df.groupBy(*keys).agg(F.min(var).alias("low"), *q, F.max(var).alias("high")), keys)


def points(ds: Dataset, x: str, y: str) -> Dataset:
    """Distinct cells of a grid with counts, so that what is drawn does not grow with the data."""
    rows = ds.df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b, c, d = rows.agg(F.min(x), F.max(x), F.min(y), F.max(y)).head()
    if a is None:
        return plain(rows.select(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(1.0).alias("count")), ["x", "y"])
    cell = lambda v, low, high: F.floor((F.col(v) - low) / ((high - low) / CELLS or 1.0))
    grouped = rows.groupBy(cell(x, a, b).alias("i"), cell(y, c, d).alias("j")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").cast("double").alias("count"))
    return plain(grouped.select("x", "y", "count"), ["x", "y"])


def density(ds: Dataset, var: str, grid: int = 64) -> Dataset:
    """A Gaussian kernel estimate on a grid, from values counted in 512 bins."""
    r = ds.df.agg(F.count(var).alias("n"), F.stddev_samp(var).alias("s"), F.min(var).alias("a"), F.max(var).alias("b")).head()
    h = 1.06 * (r["s"] or 1.0) * r["n"] ** -0.2
    width = (r["b"] - r["a"]) / 512 or 1.0
    counts = ds.df.where(F.col(var).isNotNull()).groupBy(F.floor((F.col(var) - r["a"]) / width).alias("k")).agg(F.count("*").alias("m"), F.avg(var).alias("v"))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: r["a"] - 3 * h + i * ((r["b"] - r["a"] + 6 * h) / (grid - 1))))
    z = (F.col("x") - F.col("v")) / h
    out = counts.select("m", "v", at.alias("x")).groupBy("x").agg((F.sum(F.col("m") * F.exp(-z * z / 2)) / (r["n"] * h * 2.5066282746310002)).alias("density"))
    return plain(out, ["x"])


class Canvas:
    """Shapes in data units, drawn when all are there."""

    def __init__(self, title: str = ""):
        self.title, self.shapes = title, []

    def rect(self, x0, y0, x1, y1):
        self.shapes.append(("rect", x0, y0, x1, y1))

    def line(self, xs, ys):
        self.shapes.append(("line", list(xs), list(ys)))

    def dot(self, x, y):
        self.shapes.append(("dot", x, y))

    def rule(self, x):
        self.shapes.append(("rule", x))

    def _scale(self):
        xs, ys = [], []
        for s in self.shapes:
            if s[0] == "rect":
                xs += [s[1], s[3]]
                ys += [s[2], s[4]]
            elif s[0] == "line":
                xs += s[1]
                ys += s[2]
            elif s[0] == "dot":
                xs.append(s[1])
                ys.append(s[2])
            else:
                xs.append(s[1])
        x0, x1, y0, y1 = min(xs, default=0), max(xs, default=1), min(ys, default=0), max(ys, default=1)
        fx = lambda x: EDGE + (x - x0) / ((x1 - x0) or 1) * (WIDTH - 2 * EDGE)
        fy = lambda y: HEIGHT - EDGE - (y - y0) / ((y1 - y0) or 1) * (HEIGHT - 2 * EDGE)
        return fx, fy, (x0, x1, y0, y1)

    def save(self, path: str) -> None:
        if path.lower().endswith(".png"):
            with open(path, "wb") as f:
                f.write(self.png())
        else:
            with open(path, "w", encoding="utf-8") as f:
                f.write(self.svg())

    def svg(self) -> str:
        fx, fy, (x0, x1, y0, y1) = self._scale()
        out = [f"<svg xmlns='http://www.w3.org/2000/svg' width='{WIDTH}' height='{HEIGHT}'><rect width='100%' height='100%' fill='white'/>", f"<text x='{WIDTH // 2}' y='24' text-anchor='middle'>{self.title}</text>"]
        out.append(f"<path d='M{EDGE} {EDGE}V{HEIGHT - EDGE}H{WIDTH - EDGE}' fill='none' stroke='black'/>")
        for x in (x0, x1):
            out.append(f"<text x='{fx(x):.1f}' y='{HEIGHT - EDGE + 18}' text-anchor='middle' font-size='11'>{x:g}</text>")
        for y in (y0, y1):
            out.append(f"<text x='{EDGE - 6}' y='{fy(y):.1f}' text-anchor='end' font-size='11'>{y:g}</text>")
        for s in self.shapes:
            if s[0] == "rect":
                a, b, c, d = fx(s[1]), fy(s[4]), fx(s[3]), fy(s[2])
                out.append(f"<rect x='{a:.1f}' y='{b:.1f}' width='{max(1, c - a):.1f}' height='{max(0, d - b):.1f}' fill='steelblue' stroke='white'/>")
            elif s[0] == "line":
                out.append("<polyline fill='none' stroke='steelblue' points='" + " ".join(f"{fx(x):.1f},{fy(y):.1f}" for x, y in zip(s[1], s[2], strict=True)) + "'/>")
            elif s[0] == "dot":
                out.append(f"<circle cx='{fx(s[1]):.1f}' cy='{fy(s[2]):.1f}' r='3' fill='steelblue'/>")
            else:
                out.append(f"<path d='M{fx(s[1]):.1f} {EDGE}V{HEIGHT - EDGE}' stroke='firebrick'/>")
        return "\n".join([*out, "</svg>"])

    def png(self) -> bytes:
        fx, fy, _ = self._scale()
        grid = [bytearray(b"\xff" * WIDTH * 3) for _ in range(HEIGHT)]

        def fill(a, b, c, d, colour):
            for y in range(max(0, int(min(b, d))), min(HEIGHT, int(max(b, d)) + 1)):
                low, high = max(0, int(min(a, c))), min(WIDTH, int(max(a, c)) + 1)
                grid[y][3 * low : 3 * high] = bytes(colour) * (high - low)

        def stroke(a, b, c, d, colour):
            n = int(max(abs(c - a), abs(d - b))) + 1
            for k in range(n + 1):
                x, y = a + (c - a) * k / n, b + (d - b) * k / n
                fill(x, y, x, y, colour)

        blue, black, red = (70, 130, 180), (0, 0, 0), (178, 34, 34)
        stroke(EDGE, EDGE, EDGE, HEIGHT - EDGE, black)
        stroke(EDGE, HEIGHT - EDGE, WIDTH - EDGE, HEIGHT - EDGE, black)
        for s in self.shapes:
            if s[0] == "rect":
                fill(fx(s[1]) + 1, fy(s[2]), fx(s[3]) - 1, fy(s[4]), blue)
            elif s[0] == "line":
                for (x, y), (u, v) in zip(zip(s[1], s[2], strict=True), zip(s[1][1:], s[2][1:], strict=True), strict=False):
                    stroke(fx(x), fy(y), fx(u), fy(v), blue)
            elif s[0] == "dot":
                fill(fx(s[1]) - 2, fy(s[2]) - 2, fx(s[1]) + 2, fy(s[2]) + 2, blue)
            else:
                stroke(fx(s[1]), EDGE, fx(s[1]), HEIGHT - EDGE, red)
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, HEIGHT, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in grid))) + chunk(b"IEND", b"")
