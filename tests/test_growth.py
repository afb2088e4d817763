"""Plans that hold for large tables: what grows with the input is neither broadcast nor paired where that is not asked for."""

import random
import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from slidespark import registry
from slidespark.functions import raster, triangulation
from slidespark.operators import graph, spatial
from slidespark.operators.components import components

from .differential import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the shared tables are not here")


def plans_of(spark, name):
    """The plans of all that the query runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    registry.queries()[name](spark, SF).count()
    made = store.executionsList(before, 100_000)
    return [made.apply(i).physicalPlanDescription() for i in range(made.size())]


@pytest.mark.parametrize("name", ["label_compact", "label_components"])
def test_labels_are_not_broadcast(spark, name):
    plans = plans_of(spark, name)
    assert len(plans) > 2 and not any("BroadcastExchange" in p for p in plans)


@pytest.mark.parametrize("name", ["piece_components", "piece_cellularity"])
def test_pieces_are_not_broadcast(spark, name):
    """Only tables with a row for each slide are."""
    keys = [k for p in plans_of(spark, name) for k in re.findall(r"BroadcastHashJoin[^\n]*\nLeft keys \[\d+\]: \[([^\]]*)\]", p)]
    assert {re.sub(r"#\d+", "", k) for k in keys} <= {"slide_id"}


def test_codes_of_full_slides(spark, tmp_path):
    """A slide of more elements than codes: the first ones in drawing order have one, as in the SQL."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range o_orderkey, range % 3 o_custkey, 1000.0 + range * 7 % 90001 o_totalprice, CASE range % 2 WHEN 0 THEN '1-URGENT' ELSE '5-LOW' END o_orderpriority FROM range(53000)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT range c_custkey, CAST(range AS INT) c_nationkey FROM range(3)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    name = "object_mask_codes"
    assert compare(registry.queries()[name](spark, str(tmp_path)), connect(str(tmp_path)), registry.oracle_sql()[name]) == ""


def test_clusters_need_no_pairs(spark):
    """Links of crowded boxes grow with the boxes; components are those of all pairs nearer than the reach, boxes without a group alone."""
    rng = random.Random(5)
    rows = [(k % 2, None if k % 50 == 0 else "g", k, x, y, x + rng.randrange(30), y + rng.randrange(30)) for k in range(400) for x, y in [(rng.choice((0, 300, rng.randrange(900))), rng.randrange(60))]]
    e = spark.createDataFrame(rows, "slide_id int, grp string, element_id long, xmin int, ymin int, xmax int, ymax int")
    links = spatial.near_forest(e, 3)
    assert links.count() <= 3 * len(rows) < spatial.gaps(e, 3).count()
    root = {r[2]: r[2] for r in rows}
    near = spatial.gaps(e, 3).collect()
    while any(root[p.a] != root[p.b] for p in near):
        for p in near:
            root[p.a] = root[p.b] = min(root[p.a], root[p.b])
    found = {r.v: r.root for r in components(links).collect()}
    assert {k: found.get(k, k) for k in root} == root
    clustered = e.join(spark.createDataFrame(list(root.items()), "element_id long, cluster long"), "element_id")
    want = {}
    for r in rows:
        want.setdefault(root[r[2]], set()).update((y, x) for y in range(r[4], r[6] + 1) for x in range(r[3], r[5] + 1))
    got = {}
    for r in spatial.union_runs(clustered, "cluster").collect():
        for x in range(r.x0, r.x1 + 1):
            assert (r.y, x) not in got.setdefault(r.cluster, set())
            got[r.cluster].add((r.y, x))
    assert got == want


def test_crowded_points_ask_few(spark):
    """Points in a heap look into small cells first, and find the same neighbours."""
    rng = random.Random(3)
    rows = [(k, 0, rng.randrange(40), rng.randrange(40)) for k in range(600)] + [(600, 0, 900, 900)]
    points = spark.createDataFrame(rows, "vec_id long, label int, cx int, cy int")
    cell = graph._first_cell(points, 3, 64)
    assert cell < 64 and graph._near_cells(points, cell, points).count() < 601 * 600 / 4
    got = {}
    for r in graph.nearest(points, 3).collect():
        got.setdefault(r.vec_id, {})[r.place] = (r.d2, r.other)
    for v, _, x, y in rows:
        want = sorted(((x - p) ** 2 + (y - q) ** 2, o) for o, _, p, q in rows if o != v)[:3]
        assert [got[v][i] for i in (1, 2, 3)] == want


def test_painting_counts_numbers(spark):
    """What shows at a cell is a maximum that a hash table holds."""
    assert "SortAggregate" not in "".join(plans_of(spark, "painter_areas"))


def test_sweep_of_points_is_not_square():
    """Triangles behind the front are set aside: twice the points take far less than four times as long, and triangles are Delaunay's."""
    rng = np.random.default_rng(2)
    p = np.unique(rng.integers(0, 30, (200, 2)).astype(float), axis=0)
    tri = triangulation.delaunay(p)
    centre, r2 = triangulation._circles(p, tri)
    assert (((p[None] - centre[:, None]) ** 2).sum(axis=2) >= r2[:, None] * (1 - 1e-9) - 1e-9).all()
    held = []
    seen = triangulation._circles
    q = np.unique(rng.random((1500, 2)) * 1000, axis=0)
    rows = lambda f: held.append(f.f_locals["tri"].shape[0]) if f.f_code.co_name == "delaunay" else None
    try:
        triangulation._circles = lambda a, b: (rows(sys._getframe(1)), seen(a, b))[1]
        triangulation.delaunay(q)
    finally:
        triangulation._circles = seen
    assert max(held) < 1500


def test_oriented_blobs_convolve_once():
    rng = np.random.default_rng(1)
    im, sigmas = rng.random((9, 7)), [1.0, 2.0, 3.0]
    want = np.zeros(im.shape)
    for i, sx in enumerate(sigmas):
        for sy in sigmas[: i + 1]:
            for k in range(8 if sx != sy else 1):
                want -= (1 + np.log(sx) ** 2) * (1 + np.log(sy) ** 2) * raster.convolve(im, raster.oriented_kernel(sx, sy, np.pi * k / 8))
    calls, one = [], raster.convolve
    try:
        raster.convolve = lambda *a: calls.append(1) or one(*a)
        got = raster.oriented_scales(im, sigmas)
    finally:
        raster.convolve = one
    assert len(calls) == 1 and np.abs(got - want).max() < 1e-12
