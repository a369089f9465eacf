"""The whole chain on pictures of the events table, stage by stage against plain loops."""

import hashlib

import duckdb
import numpy as np
from helpers import DATA
from test_golden import direct_albedo

from gridloom.plans import registry
from gridloom.sources import raster


def pictures(events, cells, side):
    """Name and colours (height, width, 3) of every picture, from the table."""
    kinds, out = ("click", "error", "purchase"), {}
    for n, user, kind in duckdb.sql(f"SELECT event_id // {events}, user_id, event_type FROM '{DATA}/events.parquet'").fetchall():
        out.setdefault(f"events-{n}", [[] for _ in range(cells * cells)])[user % (cells * cells)].append(kind)
    for name, found in out.items():
        colours = np.array([[min(1.0, 3 * c.count(k) / len(c)) if c else 0.0 for k in kinds] for c in found]).reshape(cells, cells, 3)
        out[name] = colours.repeat(side, 0).repeat(side, 1)
    return out


def lab(rgb):
    v = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92) * 100
    # sRGB to XYZ (D65), and the white point.
    m = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
    t = v @ m.T / np.array([95.047, 100.0, 108.883])
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return 116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])


def clusters(name, features, k):
    order = sorted(range(len(features)), key=lambda i: (hashlib.md5(f"{name}/{i}/0".encode()).hexdigest(), i))
    c, before = features[order[:k]], np.inf
    for _ in range(100):
        label = ((features[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([features[label == j].mean(0) if (label == j).any() else np.zeros(3) for j in range(k)])
        moved = np.sqrt(((new - c) ** 2).sum())
        c, done, before = new, abs(moved - before) <= 1e-3, moved
        if done:
            break
    return label


def regions(label):
    """Numbered by their greatest pixel, from 0."""
    h, w = label.shape
    seen, found = np.full((h, w), -1), []
    for start in np.ndindex(h, w):
        if seen[start] >= 0:
            continue
        todo, own = [start], []
        seen[start] = len(found)
        while todo:
            y, x = todo.pop()
            own.append(y * w + x)
            for at in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= at[0] < h and 0 <= at[1] < w and seen[at] < 0 and label[at] == label[start]:
                    seen[at] = len(found)
                    todo.append(at)
        found.append(max(own))
    return np.argsort(np.argsort(found))[seen]


def eroded(line, n):
    out, start = line.copy(), 0
    for i in range(1, len(line) + 1):
        if i == len(line) or line[i] != line[start]:
            out[start : min(start + n, i)] = out[max(i - n, start) : i] = -1
            start = i
    return out


def expected(name, stored, k=5, erosion=10):
    rgb = np.maximum((np.floor(np.clip(stored, 0, 1) * 255 + 0.5) / 255) ** 2.2, 1 / 255)
    i = rgb.sum(2) / 3
    cr, cg = rgb[..., 0] / i, rgb[..., 1] / i
    light = direct_albedo(i, cr, cg, 20, 5)
    albedo = np.stack([light * cr, light * cg, light * (3 - cr - cg)], 2)
    bright, a, b = lab(rgb)
    grey = (abs(a) < 0.2 * abs(a).max()) & (abs(b) < 0.2 * abs(a).max())
    beta = np.where(grey & (bright < 0.2 * bright.max()), -1e5, np.where(grey & (bright > 0.95 * bright.max()), 1e5, 0.0))
    cluster = clusters(name, np.stack([beta, a, b], 2).reshape(-1, 3), k).reshape(i.shape)
    component = regions(cluster)
    label = np.apply_along_axis(eroded, 0, component, erosion)
    label = np.apply_along_axis(eroded, 1, label, erosion)
    names = sorted(set(label[label >= 0].tolist()))
    label = np.where(label >= 0, np.searchsorted(names, label), -1)
    logs = []
    for s in range(len(names)):
        own = albedo[label == s]
        near = np.argsort(((own + own.mean(0)) ** 2).sum(1), kind="stable")[:10]
        logs.append(20 * np.log(((albedo[:, :, None] + own[near]) ** 2).sum(3).mean(2)))
    p = np.exp(np.array(logs) - np.max(logs, axis=0))
    return cluster, component, label, p / p.sum(0)


def test_chain_equals_plain_loops(spark):
    want = pictures(5000, 3, 32)
    got = registry.QUERIES["segmentation_pictures"](spark, DATA).toPandas().sort_values(["image_id", "pid"])
    assert set(got["image_id"]) == {n + m for n in want for m in ("", "-mirror")} and len(got) == 2 * len(want) * 96 * 96
    for name, stored in want.items():
        own, other = (got[got["image_id"] == n] for n in (name, f"{name}-mirror"))
        cluster, component, label, p = expected(name, stored)
        assert len(np.unique(component)) > 1 and label.max() >= 1
        for column, found in (("cluster", cluster), ("component", component), ("label", label)):
            assert (own[column].to_numpy().reshape(96, 96) == found).all(), column
        top = np.sort(p, axis=0)
        assert np.allclose(own["p"].to_numpy().reshape(96, 96), top[-1], atol=2e-4)
        clear = top[-1] - top[-2] > 1e-3
        assert (own["best"].to_numpy().reshape(96, 96) == p.argmax(0))[clear].all()
        # The mirror image: the same clusters and the same foreground, from right to left; regions by other numbers.
        turn = lambda pdf, c: pdf[c].to_numpy().reshape(96, 96)[:, ::-1]
        assert (turn(other, "cluster") == cluster).all() and ((turn(other, "label") >= 0) == (label >= 0)).all()
        assert np.allclose(turn(other, "p"), top[-1], atol=2e-4)
        for column, found in (("component", component), ("label", label)):
            pairs = set(zip(turn(other, column).ravel().tolist(), found.ravel().tolist(), strict=True))
            assert len(pairs) == len(np.unique(found))


def test_pictures(spark):
    want = pictures(150, 2, 5)
    got = raster.event_pictures(spark, DATA, 150, 2, 5).toPandas().sort_values(["image_id", "pid"])
    assert set(got["image_id"]) == set(want)
    for name, stored in want.items():
        own = got[got["image_id"] == name]
        assert own["pid"].tolist() == list(range(100)) and (own["y"] * 10 + own["x"] == own["pid"]).all()
        assert np.allclose(own[["c0", "c1", "c2"]].to_numpy().reshape(10, 10, 3), stored)
