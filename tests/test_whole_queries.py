"""Queries over masks, galleries and rings against plain definitions."""

from pathlib import Path

import pytest

from slidespark import registry
from slidespark.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the shared tables are not here")


def test_every_polygon_has_a_mask(spark):
    want = {}
    for e in fx.elements(spark, SF).collect():
        w, h = e.xmax - e.xmin, e.ymax - e.ymin
        want[e.element_id] = sum(sum(x * h < w * h - y * w for x in range(w)) for y in range(h))
    got = {r.element_id: r.n for r in registry.queries()["polygon_mask"](spark, SF).collect()}
    assert got == want


def test_every_tile_has_a_place(spark):
    slides = {}
    for e in fx.elements(spark, SF).collect():
        slides.setdefault(e.slide_id, []).append((e.element_id, e.xmax - e.xmin, e.ymax - e.ymin))
    want = set()
    for slide, tiles in slides.items():
        tiles.sort()
        for g in range(0, len(tiles), 10):
            y = 1
            for r in range(g, min(g + 10, len(tiles)), 2):
                strip, x, y = tiles[r : min(r + 2, g + 10)], 1, y + 25
                for c, (tile, w, h) in enumerate(strip):
                    x += 25
                    want.add((slide, tile, g // 10, (r - g) // 2, c, x, y, x + w, y + h))
                    x += w
                y += max(h for _, _, h in strip)
    got = registry.queries()["gallery_layout"](spark, SF).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_every_object_has_a_ring(spark):
    slides = {}
    for b in fx.blocks(spark, SF).collect():
        slides.setdefault(b.slide_id, {})[b.y, b.x] = b.label
    want = set()
    for slide, at in slides.items():
        for y in range(48):
            for x in range(48):
                near = [(dy * dy + dx * dx, at[y + dy, x + dx]) for dy in range(-4, 5) for dx in range(-4, 5) if dy * dy + dx * dx <= 16 and (y + dy, x + dx) in at]
                if near and (y, x) not in at:
                    want.add((slide, y, x, min(near)[1]))
    got = registry.queries()["ring_labels"](spark, SF).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
