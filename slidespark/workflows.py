"""Work on many slides: folders of slides, callbacks, and what failed."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidespark.operators import labels, learning, pixelstats, stains, tiles, tissue
from slidespark.sources.storage import grown, materialize

log = logging.getLogger(__name__)


@dataclass
class Report:
    done: list = field(default_factory=list)
    failed: dict = field(default_factory=dict)


def slides(items: DataFrame, keep: list | None = None, discard: list | None = None, id_col: str = "slide_id") -> DataFrame:
    """Slides of a folder, those kept only or those discarded left out."""
    if keep is not None:
        items = items.where(F.col(id_col).isin(list(keep)))
    return items.where(~F.col(id_col).isin(list(discard))) if discard else items


def each(items: DataFrame, callback: Callable, id_col: str = "slide_id") -> Report:
    """Calls back for every slide in order of id; errors are logged and the slide is skipped.

    Only ids come to the driver, a partition at a time; a callback starts a job of its own.
    """
    report = Report()
    ids: Iterator = items.select(id_col).distinct().orderBy(id_col).toLocalIterator()
    for row in ids:
        try:
            callback(row[0])
            report.done.append(row[0])
        except Exception as error:  # noqa: BLE001  one slide must not stop the others
            log.warning("slide %s: %s", row[0], error)
            report.failed[row[0]] = str(error)
    return report


def apply(t: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: str = "slide_id") -> DataFrame:
    """``f`` of the rows of every slide, all slides in one job: its rows, or one row with nothing but the slide and the error where it fails."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    kind = dict(t.dtypes)[by]

    def g(rows: pd.DataFrame) -> pd.DataFrame:
        slide = rows[by].iloc[0]
        try:
            out = f(rows)[[c for c in names if c != by]].copy()
            out[by], out["error"] = slide, None
        except Exception as error:  # noqa: BLE001  one slide must not stop the others
            out = pd.DataFrame({**{c: [None] for c in names}, by: [slide], "error": [str(error)]})
        return out[[by, *(c for c in names if c != by), "error"]]

    rest = ", ".join(c.strip() for c in schema.split(",") if c.strip().split()[0] != by)
    return t.groupBy(by).applyInPandas(g, f"{by} {kind}, {rest}, error string")


def cellularity(pixels: DataFrame, components: int = 5, size: int = 8, seed: int = 7) -> DataFrame:
    """(slide_id, component, n, cellularity): superpixels of all slides, their colours as a Gaussian mixture, ranked by darkness."""
    parts = tiles.numbered(tiles.superpixels(pixels, size))
    mean = pixels.join(grown(parts), ["slide_id", "y", "x"]).groupBy("slide_id", "label").agg(*(F.avg(c).alias(c) for c in "rgb"), F.avg((F.col("r") + F.col("g") + F.col("b")) / 3).alias("intensity"))
    return learning.cellularity(learning.mixture(mean, ["r", "g", "b"], components, seed), "intensity")


def tissue_pieces(pixels: DataFrame, least: int = 10, n: int = 10, **options) -> DataFrame:
    """(slide_id, label, area, box, place): the largest pieces of tissue of every slide."""
    return labels.largest(tissue.pieces(pixels, least=least, **options), n)


CASCADE = (("white", "r + g + b > 600"), ("blue", "b > r + 20"), ("red", "r > g + 60"))


def piece_cellularity(pixels: DataFrame, components: int = 5, size: int = 8, seed: int = 7, **options) -> DataFrame:
    """(slide_id, label, component, n, cellularity): superpixels within pieces of tissue, mixed by intensity features, ranked by darkness in each piece."""
    found = tissue.pieces(pixels, **options)
    parts = tiles.numbered(tiles.superpixels(pixels, size)).withColumnRenamed("label", "part")
    inside = materialize(found.join(grown(parts), ["slide_id", "y", "x"]).join(grown(pixels), ["slide_id", "y", "x"]).select(F.struct("slide_id", "label", "part").alias("k"), *"rgb", ((F.col("r") + F.col("g") + F.col("b")) / 3).alias("i")))  # read five times
    mean = inside.groupBy("k").agg(*(F.avg(c).alias(c) for c in "rgb"))
    stats = pixelstats.intensity_features(inside, "k").select("k", F.col("mean").alias("intensity"), "std", "entropy", "iqr")
    t = materialize(mean.join(grown(stats), "k").select("k.slide_id", "k.label", *"rgb", "intensity", "std", "entropy", "iqr"))
    mixed = learning.mixture(t, [*"rgb", "intensity", "std", "entropy", "iqr"], components, seed)
    ranked = learning.cellularity(mixed.withColumn("__k", F.struct("slide_id", "label", "component")), "intensity", "__k")
    return ranked.select("__k.slide_id", "__k.label", "__k.component", "n", "cellularity")


def piece_components(pixels: DataFrame, cascade=CASCADE, reference: tuple | None = None, **options) -> DataFrame:
    """(slide_id, label, y, x, part): pixels of pieces of tissue by the first threshold that holds, ``rest`` where none does.

    With ``reference`` the colours of each slide are normalised before the rest is told apart.
    """
    image = stains.reinhard(pixels, *reference) if reference else pixels
    kind = F.coalesce(*(F.when(F.expr(test), F.lit(name)) for name, test in cascade), F.lit("rest"))
    return tissue.pieces(pixels, **options).join(grown(image), ["slide_id", "y", "x"]).select("slide_id", "label", "y", "x", kind.alias("part"))
