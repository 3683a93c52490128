"""Masks by any geometry against the exact kernel at every pixel."""

import random

import pandas as pd
import pytest

from terracell.functions import kernel, tiles
from terracell.functions.types import LINE, MULTIPOLYGON, POLYGON


def shapes():
    rng = random.Random(8)
    spot = lambda lo, hi: (float(rng.randint(lo, hi)), float(rng.randint(lo, hi)))
    for _ in range(12):
        a, b, c = (spot(-3, 12) for _ in range(3))
        if (b[0] - a[0]) * (c[1] - a[1]) != (b[1] - a[1]) * (c[0] - a[0]):
            yield POLYGON, [[[a, b, c, a]]]
    yield POLYGON, [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)], [(3.0, 3.0), (7.0, 3.0), (7.0, 7.0), (3.0, 7.0), (3.0, 3.0)]]]
    yield MULTIPOLYGON, [[[(0.0, 0.0), (3.5, 0.0), (0.0, 3.5), (0.0, 0.0)]], [[(9.0, 9.0), (6.0, 9.0), (9.0, 5.5), (9.0, 9.0)]]]
    yield LINE, [[[(1.0, 1.0), (8.5, 3.0), (2.0, 9.0)]]]


@pytest.mark.parametrize("name", ["intersects", "contains"])
def test_masks(spark, name):
    w = h = 10
    values = [float(i + 1) for i in range(w * h)]
    for kind, parts in shapes():
        t = pd.DataFrame([(0.0, 10.0, w, h, 1.0, values)], columns=list(tiles.FIELDS))
        g = pd.DataFrame({"gtype": [kind], "parts": [[[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts]]})
        out = tiles.mask_any(name, -1.0).func(t, g).iloc[0]
        if out["values"] is None:
            continue
        shape = kernel.Shape(kind, parts)
        test = kernel.intersects if name == "intersects" else kernel.contains
        want = []
        for j in range(int(out["height"])):
            for i in range(int(out["width"])):
                x, y = out["ulx"] + i, out["uly"] - j
                pixel = kernel.Shape(POLYGON, [[[(x, y - 1), (x + 1, y - 1), (x + 1, y), (x, y), (x, y - 1)]]])
                k = int(10 - y) * w + int(abs(x))
                want.append(values[k] if test(shape, pixel) and 0 <= k < 100 else -1.0)
        assert list(out["values"]) == want, (kind, parts)
