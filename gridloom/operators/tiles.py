"""Relaxation of grid equations by tiles: (mass + weight * Laplacian) v = b on whole images.

The Laplacian counts the neighbours inside the image (no flow over its edge). An
image is cut into square tiles, one row each. A round is

1. *coarse*: residuals, summed over cells of some pixels, make a small grid that one task solves for
   the image; its solution, interpolated, carries what is smooth over many tiles;
2. *sweeps*: every tile with a halo of its neighbours' pixels around it is relaxed
   for itself, the halo's outermost ring held fast: red-black successive
   over-relaxation on the tile and on ever coarser copies of it (V cycles);
3. *exchange*: tiles send the strips that their eight neighbours have as halos, and measure their residuals.

A round moves each tile once to twice, whatever the number of sweeps in it, and the number of
rounds hardly depends on the image's size. A task holds a tile with its halo, or
an image's coarse grid (``CELLS`` cells at most, so an image has CELLS * tile**2 pixels at most, 10**11 by default).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Latest, join_small, saved

TILE = 512
HALO = 32
CELLS = 1 << 19
_TILE = ["image_id", "ty", "tx"]
_KEY = "image_id string, ty int, tx int, height int, width int"
_STATE = f"{_KEY}, v binary, b binary, rr double, bb double, cells binary"
_MESSAGE = f"{_KEY}, y int, x int, h int, w int, v binary, b binary"
_PATCH = "image_id string, ty int, tx int, py int, px int, ph int, pw int, patch binary"


class Grid:
    """Cells of given widths; ``held``: sides (top, bottom, left, right) behind which values are held fast at half a pixel's distance from the edge's cell."""

    def __init__(self, cy: np.ndarray, cx: np.ndarray, held: tuple[bool, bool, bool, bool], mass: float, weight: float, omega: float = 1.0):
        self.cy, self.cx, self.held, self.omega = cy, cx, held, omega
        # A flow between two cells: the length of their common edge by the distance of their centres.
        self.wy = weight * np.outer(2 / (cy[1:] + cy[:-1]), cx)
        self.wx = weight * np.outer(cy, 2 / (cx[1:] + cx[:-1]))
        diagonal = mass * np.outer(cy, cx)
        for side, (edge, cells, depth) in enumerate(((np.s_[0], cx, cy[0]), (np.s_[-1], cx, cy[-1]), (np.s_[:, 0], cy, cx[0]), (np.s_[:, -1], cy, cx[-1]))):
            if held[side]:
                diagonal[edge] += weight * cells * 2 / (depth + 1)
        self.diagonal = diagonal + self.flows(np.ones_like(diagonal))
        self.safe = np.where(self.diagonal > 0, self.diagonal, 1.0)
        self.free = mass == 0 and not any(held)
        self.colours = [np.add.outer(np.arange(len(cy)), np.arange(len(cx))) % 2 == k for k in (0, 1)]
        self.coarse = None
        if max(len(cy), len(cx)) > 3:
            pairs = lambda c: np.add.reduceat(c, np.arange(0, len(c), 2))
            self.coarse = Grid(pairs(cy), pairs(cx), held, mass, weight, omega)
            self.up = Between(self.coarse.cy, centres(cy), *held[:2]), Between(self.coarse.cx, centres(cx), *held[2:])

    def flows(self, v: np.ndarray) -> np.ndarray:
        """Neighbours' values by their weights."""
        out = np.zeros_like(v)
        out[:-1] += self.wy * v[1:]
        out[1:] += self.wy * v[:-1]
        out[:, :-1] += self.wx * v[:, 1:]
        out[:, 1:] += self.wx * v[:, :-1]
        return out

    def residual(self, b: np.ndarray, v: np.ndarray) -> np.ndarray:
        return b + self.flows(v) - self.diagonal * v

    def sweep(self, b: np.ndarray, v: np.ndarray, colours: tuple[int, ...]) -> None:
        for k in colours:
            new = (b + self.flows(v)) / self.safe
            np.copyto(v, v + self.omega * (new - v), where=self.colours[k] & (self.diagonal > 0))

    def cycle(self, b: np.ndarray, v: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """One V cycle, in place."""
        if self.coarse is None:
            for _ in range(12):
                self.sweep(b, v, (0, 1))
                self.sweep(b, v, (1, 0))
            return v
        for _ in range(sweeps):
            self.sweep(b, v, (0, 1))
        r = _back(*self.up, self.residual(b, v))
        if self.free:
            r -= r.sum() / r.size
        v += _there(*self.up, self.coarse.cycle(r, np.zeros_like(r), sweeps))
        for _ in range(sweeps):
            self.sweep(b, v, (1, 0))
        return v


def centres(c: np.ndarray) -> np.ndarray:
    return np.cumsum(c) - c / 2


class Between:
    """Values at ordered places from those of cells along one side: linear between centres, constant beyond the
    last ones, or falling to zero half a pixel outside a held end. And its transpose, which deals values at places out to cells."""

    def __init__(self, c: np.ndarray, at: np.ndarray, low: bool = False, high: bool = False):
        ends = np.concatenate([[-0.5 if low else -1e9], centres(c), [c.sum() + 0.5 if high else 1e9]])
        k = np.clip(np.searchsorted(ends, at, side="right") - 1, 0, len(c))
        t = (at - ends[k]) / (ends[k + 1] - ends[k])
        t = np.where((k == 0) & (not low), 1.0, t)
        self.k, self.t = k, np.where((k == len(c)) & (not high), 0.0, t)
        self.n = len(c)
        self.first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))

    def there(self, v: np.ndarray) -> np.ndarray:
        """Along the first axis."""
        padded = np.concatenate([np.zeros_like(v[:1]), v, np.zeros_like(v[:1])])
        return padded[self.k] * (1 - self.t)[:, None] + padded[self.k + 1] * self.t[:, None]

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n + 2, r.shape[1]))
        at = self.k[self.first]
        out[at] += np.add.reduceat(r * (1 - self.t)[:, None], self.first)
        out[at + 1] += np.add.reduceat(r * self.t[:, None], self.first)
        return out[1:-1]


def _there(y: Between, x: Between, v: np.ndarray) -> np.ndarray:
    return x.there(y.there(v).T).T


def _back(y: Between, x: Between, r: np.ndarray) -> np.ndarray:
    return x.back(y.back(r).T).T


def _widths(size: int, cell: int) -> np.ndarray:
    """Widths of the cells of a side."""
    return np.diff(np.append(np.arange(0, size, cell), size)).astype(float)


class Frame:
    """Where a tile and its halo lie in the image: rows from y0, before y1, and so on; with the halo from oy0, before oy1."""

    def __init__(self, ty: int, tx: int, height: int, width: int, tile: int, halo: int):
        self.y0, self.x0 = ty * tile, tx * tile
        self.y1, self.x1 = min(height, self.y0 + tile), min(width, self.x0 + tile)
        self.oy0, self.ox0 = max(0, self.y0 - halo), max(0, self.x0 - halo)
        self.oy1, self.ox1 = min(height, self.y1 + halo), min(width, self.x1 + halo)
        self.held = (self.oy0 > 0, self.oy1 < height, self.ox0 > 0, self.ox1 < width)
        self.shape = self.oy1 - self.oy0, self.ox1 - self.ox0
        self.own = np.s_[self.y0 - self.oy0 : self.y1 - self.oy0, self.x0 - self.ox0 : self.x1 - self.ox0]

    def loose(self) -> tuple[slice, slice]:
        """What isn't the outermost ring of a halo."""
        top, bottom, left, right = self.held
        return slice(int(top), self.shape[0] - int(bottom)), slice(int(left), self.shape[1] - int(right))


def _array(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(shape)


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[t]) for n, t in fields], [n for n, _ in fields])


def _gather(tile: int):
    """Pixels of a tile as one row."""

    def run(pixels: pa.Table) -> pa.Table:
        first = {n: pixels[n][0].as_py() for n in ("image_id", "ty", "tx", "height", "width")}
        f = Frame(first["ty"], first["tx"], first["height"], first["width"], tile, 0)
        v = np.zeros(f.shape)
        v[pixels["y"].to_numpy() - f.y0, pixels["x"].to_numpy() - f.x0] = pa.compute.fill_null(pixels["b"], 0.0).to_numpy()
        return pa.Table.from_batches([_batch(f"{_KEY}, v binary, b binary", [first | {"v": v.tobytes()}])])

    return run


def _strips(row: dict, v: np.ndarray, tile: int, halo: int) -> Iterator[dict]:
    """A tile's own pixels, to itself and, in parts, to its neighbours."""
    f = Frame(row["ty"], row["tx"], row["height"], row["width"], tile, halo)
    key = {n: row[n] for n in ("image_id", "height", "width")}
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            ty, tx = row["ty"] + dy, row["tx"] + dx
            if not (0 <= ty * tile < row["height"] and 0 <= tx * tile < row["width"]):
                continue
            to = Frame(ty, tx, row["height"], row["width"], tile, halo)
            y0, y1, x0, x1 = max(f.y0, to.oy0), min(f.y1, to.oy1), max(f.x0, to.ox0), min(f.x1, to.ox1)
            part = v[y0 - f.y0 : y1 - f.y0, x0 - f.x0 : x1 - f.x0]
            yield key | {"ty": ty, "tx": tx, "y": y0 - to.oy0, "x": x0 - to.ox0, "h": y1 - y0, "w": x1 - x0, "v": part.tobytes(), "b": row["b"] if dy == dx == 0 else None}


def _send(tile: int, halo: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in _rows(batch):
                f = Frame(row["ty"], row["tx"], row["height"], row["width"], tile, 0)
                yield _batch(_MESSAGE, list(_strips(row, _array(row["v"], f.shape), tile, halo)))

    return run


def _own_cells(n: int, t: int, size: int, tile: int, cell: int) -> tuple[Between, int]:
    """From a tile's n pixels along a side to its cells and one more at either end; and the first of these."""
    widths, per = _widths(size, cell), tile // cell
    first = max(0, t * per - 1)
    return Between(widths[first : (t + 1) * per + 1], t * tile - first * cell + np.arange(n) + 0.5), first


def _measured(key: dict, v: np.ndarray, b: np.ndarray, f: Frame, mass: float, weight: float, tile: int, cell: int, pinned: bool) -> dict:
    """A tile's state: values, right side, squares of its residual and right side, and its residual dealt out to cells.

    Where tiles meet, residuals come in pairs of opposite sign on either side; cells take shares by distance, as a
    sum by cell would carry such a pair as far apart as cells are."""
    grid = Grid(np.ones(f.shape[0]), np.ones(f.shape[1]), (False,) * 4, mass, weight)  # right inside the halo's ring
    r = grid.residual(b, v)[f.own]
    bb = b[f.own].copy()
    if pinned and f.y0 == f.x0 == 0:
        bb[0, 0] = 0
    (y, _), (x, _) = (_own_cells(n, key[k], key[s], tile, cell) for n, k, s in ((r.shape[0], "ty", "height"), (r.shape[1], "tx", "width")))
    cells = _back(y, x, r)
    return key | {"v": v.tobytes(), "b": b.tobytes(), "rr": float((r * r).sum()), "bb": float((bb * bb).sum()), "cells": cells.tobytes()}


def _assemble(tile: int, halo: int, mass: float, weight: float, cell: int, pinned: bool):
    """Own pixels and strips to a tile with its halo. The first time, what was sent is the right side, and values start at zero."""

    def run(messages: pa.Table) -> pa.Table:
        rows = list(_rows(messages))
        key = {n: rows[0][n] for n in ("image_id", "ty", "tx", "height", "width")}
        f = Frame(*(key[n] for n in ("ty", "tx", "height", "width")), tile, halo)
        v, b = np.zeros(f.shape), None
        for r in rows:
            v[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = _array(r["v"], (r["h"], r["w"]))
            b = b if r["b"] is None else _array(r["b"], f.shape)
        if b is None:
            v, b = np.zeros(f.shape), v
        return pa.Table.from_batches([_batch(_STATE, [_measured(key, v, b, f, mass, weight, tile, cell, pinned)])])

    return run


def _cells(tile: int, cell: int, halo: int, mass: float, weight: float, cycles: int):
    """An image's coarse grid, solved, and cut into patches for its tiles."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(_rows(table))
        height, width = rows[0]["height"], rows[0]["width"]
        cy, cx = _widths(height, cell), _widths(width, cell)
        per = tile // cell
        b = np.zeros((len(cy), len(cx)))
        for r in rows:
            (y, y1), (x, x1) = ((max(0, r[t] * per - 1), min(n, (r[t] + 1) * per + 1)) for t, n in (("ty", len(cy)), ("tx", len(cx))))
            b[y:y1, x:x1] += _array(r["cells"], (y1 - y, x1 - x))
        grid = Grid(cy, cx, (False,) * 4, mass, weight)
        if grid.free:
            b -= b.sum() / b.size
        v = np.zeros_like(b)
        for _ in range(cycles):
            grid.cycle(b, v)
        out, around = [], -(-halo // cell) + 1
        for r in rows:
            y, x = max(0, r["ty"] * per - around), max(0, r["tx"] * per - around)
            part = v[y : (r["ty"] + 1) * per + around, x : (r["tx"] + 1) * per + around]
            out.append({n: r[n] for n in _TILE} | {"py": y, "px": x, "ph": part.shape[0], "pw": part.shape[1], "patch": part.tobytes()})
        return pa.Table.from_batches([_batch(_PATCH, out)])

    return run


def _relax(tile: int, halo: int, mass: float, weight: float, omega: float, cell: int, cycles: int):
    """Add the coarse grid's correction, relax the tile with its halo, and send strips."""
    kept: dict[tuple, Grid] = {}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in _rows(batch):
                f = Frame(row["ty"], row["tx"], row["height"], row["width"], tile, halo)
                v, b = _array(row["v"], f.shape).copy(), _array(row["b"], f.shape)
                cy, cx = (_widths(row[n], cell)[row[p] : row[p] + row[s]] for n, p, s in (("height", "py", "ph"), ("width", "px", "pw")))
                up = Between(cy, np.arange(f.oy0, f.oy1) + 0.5 - row["py"] * cell), Between(cx, np.arange(f.ox0, f.ox1) + 0.5 - row["px"] * cell)
                v += _there(*up, _array(row["patch"], (row["ph"], row["pw"])))
                inside = f.loose()
                key = v[inside].shape, f.held
                if key not in kept:
                    kept.clear()
                    kept[key] = Grid(np.ones(key[0][0]), np.ones(key[0][1]), f.held, mass, weight, omega)
                grid = kept[key]
                # What the ring sends in is part of the right side.
                ring = v.copy()
                ring[inside] = 0
                side = b[inside].copy()
                around = np.pad(ring, 1)[inside[0].start : inside[0].stop + 2, inside[1].start : inside[1].stop + 2]
                side += weight * (around[:-2, 1:-1] + around[2:, 1:-1] + around[1:-1, :-2] + around[1:-1, 2:])
                new = v[inside].copy()
                for _ in range(cycles):
                    grid.cycle(side, new)
                v[inside] = new
                yield _batch(_MESSAGE, list(_strips(row, v[f.own], tile, halo)))

    return run


def _pixels(tile: int, halo: int, at_once: int = 1 << 16):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in _rows(batch):
                f = Frame(row["ty"], row["tx"], row["height"], row["width"], tile, halo)
                own = _array(row["v"], f.shape)[f.own]
                flat, w = own.ravel(), own.shape[1]
                for start in range(0, len(flat), at_once):
                    k = np.arange(start, min(start + at_once, len(flat)))
                    y, x = f.y0 + k // w, f.x0 + k % w
                    yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]] * len(k), pa.string()), pa.array(y * row["width"] + x), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(flat[k])], ["image_id", "pid", "x", "y", "v"])

    return run


def cell_size(height: int, width: int, tile: int) -> int:
    """Pixels of a cell's side: the smallest power of two, from 8 on, that divides a tile and leaves at most CELLS cells."""
    cell = min(8, tile)
    while -(-height // cell) * -(-width // cell) > CELLS and cell < tile and tile % (2 * cell) == 0:
        cell *= 2
    if -(-height // cell) * -(-width // cell) > CELLS:
        raise ValueError(f"an image of {height} x {width} pixels needs larger tiles than {tile}")
    return cell


def solve(
    pixels: DataFrame, value: str, mass: float, weight: float, tol: float = 1e-5, max_rounds: int = 30, pinned: bool = False, omega: float = 1.0, tile: int = TILE, halo: int = HALO, cycles: int = 4
) -> DataFrame:
    """(image_id, pid, x, y, v): solutions of (mass + weight * Laplacian) v = b for images of full grids, b being the column ``value`` (null: 0).

    Ends when every image's residual is at most ``tol`` times its b, in the
    Euclidean norm, or after ``max_rounds``; a round is 3 shuffles (strips by tile, cells by
    image, patches by tile; the last is a broadcast where patches are small), and 4 more come before the first. ``pinned``: the first pixel's
    equation is given up, so that the others can hold without a mass whatever b is; the result is then free up
    to a constant (its mean is 0 at the start).
    """
    if not 0 < halo <= tile or tile & (tile - 1):
        raise ValueError("tiles have a side of a power of two, and halos are not larger")
    size = saved(pixels.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), F.sum(value).alias("__sum")), "sizes")
    largest = size.agg(F.max("height"), F.max("width")).first()
    if largest[0] is None:
        return pixels.select("image_id", "pid", "x", "y", F.lit(None).cast("double").alias("v"))
    cell = cell_size(*largest, tile)
    b = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    df = join_small(pixels.select("image_id", "x", "y", b.alias("b")), size, "image_id", name="sizes")
    if pinned:
        df = df.withColumn("b", F.when((F.col("x") == 0) & (F.col("y") == 0), F.col("b") - F.coalesce("__sum", F.lit(0.0))).otherwise(F.col("b")))
    at = lambda c: F.floor(F.col(c) / tile).cast("int").alias(f"t{c}")
    tiles = df.select("image_id", at("y"), at("x"), "height", "width", "y", "x", "b").groupBy(*_TILE).applyInArrow(_gather(tile), f"{_KEY}, v binary, b binary")
    assemble = _assemble(tile, halo, mass, weight, cell, pinned)
    rounds = Latest(pixels.sparkSession, "tiles", "none")
    state = rounds.put(tiles.mapInArrow(_send(tile, halo), _MESSAGE).groupBy(*_TILE).applyInArrow(assemble, _STATE))
    for _ in range(max_rounds):
        sums = state.groupBy("image_id").agg(F.sum("rr").alias("rr"), F.sum("bb").alias("bb"))
        if sums.filter(F.sqrt("rr") > tol * F.sqrt("bb")).isEmpty():
            break
        patches = state.select(*_TILE, "height", "width", "cells").groupBy("image_id").applyInArrow(_cells(tile, cell, halo, mass, weight, 6), _PATCH)
        relaxed = state.drop("rr", "bb", "cells").join(patches, _TILE).mapInArrow(_relax(tile, halo, mass, weight, omega, cell, cycles), _MESSAGE)
        state = rounds.put(relaxed.groupBy(*_TILE).applyInArrow(assemble, _STATE))
    return state.select("image_id", "ty", "tx", "height", "width", "v").mapInArrow(_pixels(tile, halo), "image_id string, pid long, x int, y int, v double")
