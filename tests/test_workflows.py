import sqlite3

import pandas as pd
import pytest

from pyspark.sql import functions as F

from slidespark import cli, workflows
from slidespark.operators import learning, stains, tiles
from slidespark.sources import tables


@pytest.fixture(scope="module")
def pixels(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pixels"))
    dark = lambda s, y, x: min((y - a) ** 2 + (x - b) ** 2 for a, b in ((8, 8), (20, 30), (30, 12 + 3 * s))) <= 12
    rows = [(s, y, x, *((90, 60, 140) if dark(s, y, x) else (240, 235, 240))) for s in (1, 2) for y in range(40) for x in range(40)]
    spark.createDataFrame(rows, "slide_id int, y int, x int, r int, g int, b int").write.mode("overwrite").parquet(at)
    return at


@pytest.mark.parametrize("command", ["background-intensity", "color-deconvolution", "separate-stains-pca", "separate-stains-nmf", "positive-pixel-count", "superpixels"])
def test_commands(spark, pixels, tmp_path, command):
    cli.main([command, "--pixels", pixels, "--out", f"{tmp_path}/out", "--tile", "20"], spark)
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0


def test_nuclei_do_not_hang_on_tiles(spark, pixels, tmp_path):
    found = []
    for tile in (13, 40):
        cli.main(["nuclei-features", "--pixels", pixels, "--out", f"{tmp_path}/{tile}.csv", "--tile", str(tile), "--halo", "10", "--threshold", "150", "--slides", "1"], spark)
        t = spark.read.csv(f"{tmp_path}/{tile}.csv", header=True, inferSchema=True)
        found.append({(r.ymin, r.xmin, r.ymax, r.xmax, r.area) for r in t.collect()})
    assert found[0] == found[1] and len(found[0]) >= 3


def test_nuclei_at_the_rim_and_normalised(spark, pixels):
    px = spark.read.parquet(pixels).where("slide_id = 1")
    whole = px.where("y >= 8 and y <= 32").withColumn("y", F.col("y") - 8)  # cuts two nuclei in half
    p = tiles.Nuclei(150.0, smooth=1.0)
    every, inner = (tiles.detect_nuclei(whole, 40, 0, p, drop_border=b).collect() for b in (False, True))
    assert len(inner) < len(every) and all(0 < n.ymin and n.ymax < 24 for n in inner)
    t = stains.reinhard(px, (8.6, -0.1, 0.04), (0.5, 0.1, 0.01)).collect()
    assert len(t) == 1600 and all(0 <= v <= 255 for r in t for v in (r.r, r.g, r.b))
    flat = stains.reinhard(px.withColumns({"r": F.lit(9), "g": F.lit(9), "b": F.lit(9)}), (8.6, -0.1, 0.04), (0.5, 0.1, 0.01))
    assert flat.select("r", "g", "b").distinct().count() == 1


def test_cytoplasm_features_of_the_command(spark, pixels, tmp_path):
    cli.main(["nuclei-features", "--pixels", pixels, "--out", f"{tmp_path}/f.parquet", "--tile", "40", "--threshold", "150", "--cytoplasm", "--cytoplasm-width", "3", "--glcm-levels", "8", "--remove-overlaps", "--reference-mu", "8.6", "-0.1", "0.04", "--reference-std", "0.5", "0.1", "0.01"], spark)
    t = spark.read.parquet(f"{tmp_path}/f.parquet")
    assert t.where("cytoplasm_intensity_mean is not null").count() >= 2 and {"hu1", "fsd1", "orientation", "nucleus_gradient_canny_sum"} <= set(t.columns)


def test_classification(spark, pixels, tmp_path):
    cli.main(["nuclei-features", "--pixels", pixels, "--out", f"{tmp_path}/f.parquet", "--tile", "40", "--threshold", "150"], spark)
    t = spark.read.parquet(f"{tmp_path}/f.parquet")
    names = ["area", "extent", "nucleus_intensity_mean", "nucleus_haralick_entropy_mean"]
    learning.forest(names, "slide", 3).fit(t.selectExpr("*", "cast(slide_id % 2 as double) slide")).save(f"{tmp_path}/model")
    cli.main(["nuclei-classification", "--pixels", pixels, "--features", f"{tmp_path}/f.parquet", "--model", f"{tmp_path}/model", "--out", f"{tmp_path}/c.parquet"], spark)
    out = spark.read.parquet(f"{tmp_path}/c.parquet")
    assert out.count() == t.count() and {"class", "confidence"} <= set(out.columns)
    with pytest.raises(ValueError, match="missing"):
        learning.classify(t.drop("area"), None, names)


def test_each_slide(spark):
    items = spark.createDataFrame([(k,) for k in range(5)], "slide_id int")

    def call(k):
        if k == 3:
            raise RuntimeError("broken")

    report = workflows.each(workflows.slides(items, discard=[0]), call)
    assert report.done == [1, 2, 4] and report.failed == {3: "broken"}
    assert workflows.slides(items, keep=[2]).count() == 1


def test_all_slides_in_one_job(spark):
    t = spark.createDataFrame([(k, v) for k in range(4) for v in range(3)], "slide_id int, v int")

    def f(rows):
        if rows.slide_id.iloc[0] == 2:
            raise ValueError("broken")
        return pd.DataFrame({"n": [len(rows)], "total": [float(rows.v.sum())]})

    out = {r.slide_id: (r.n, r.total, r.error) for r in workflows.apply(t, f, "n int, total double").collect()}
    assert out == {k: (3, 3.0, None) if k != 2 else (None, None, "broken") for k in range(4)}


def test_cellularity_and_pieces(spark, pixels):
    px = spark.read.parquet(pixels)
    parts = workflows.cellularity(px, 2).collect()
    assert 1 <= len(parts) <= 2 and sum(r.n for r in parts) > 20 and all(0 <= r.cellularity <= 100 for r in parts)
    assert {r.place for r in workflows.tissue_pieces(px, 5, 2).collect()} == {1, 2}


def test_sqlite_and_json(spark, tmp_path):
    db = f"{tmp_path}/a.sqlite"
    t = spark.createDataFrame([(1, "a", True), (2, None, False)], "id long, name string, extra boolean")
    assert tables.append_sqlite(t.drop("extra"), db, "items") == 2 and tables.append_sqlite(t, db, "items") == 2
    with sqlite3.connect(db) as con:
        assert con.execute("SELECT count(*), count(name) FROM items").fetchone() == (4, 2)
    (tmp_path / "two.json").write_text('[{"_id": "x", "elements": [{"type": "point", "center": [1.5, 2.5, 0]}]}, {"_id": "y"}]')
    docs = tables.read_annotations(spark, str(tmp_path / "two.json"))
    tables.export_annotations(docs.union(spark.createDataFrame([("p", "no json")], "path string, json string")), f"{tmp_path}/out")
    assert {r.annotation_id: r.n_elements for r in spark.read.parquet(f"{tmp_path}/out/annotation_docs").collect()} == {"x": 1, "y": 0}
    assert spark.read.parquet(f"{tmp_path}/out/rejected").count() == 1
    assert [(r.xmin, r.ymax) for r in spark.read.parquet(f"{tmp_path}/out/annotation_elements").collect()] == [(1, 2)]
