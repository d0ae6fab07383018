"""Images as pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cellweave.sources.binning import normalize_grid

SLAB = 65536


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Raw image bytes to pixel rows, in slabs of bounded size."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            raw = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.channels)
            step = max(1, SLAB // max(1, r.width))
            for top in range(0, r.height, step):
                part = raw[top:top + step].astype(float).mean(axis=2)
                a, b = np.indices(part.shape)
                yield pd.DataFrame({"grid_id": r.grid_id, "i": (a.ravel() + top).astype("int32"),
                                    "j": b.ravel().astype("int32"), "u": part.ravel()})


def read_images(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """Image files as (grid_id, i, j, u): mean over channels, scaled to [0, 1].

    Decoding is Spark's image source; one image is one row of that source.
    """
    raw = (spark.read.format("image").option("dropInvalid", True).load(path)
           .selectExpr("image.origin AS grid_id", "image.height AS height", "image.width AS width",
                       "image.nChannels AS channels", "image.data AS data"))
    pixels = raw.mapInPandas(_unpack, "grid_id string, i int, j int, u double")
    return normalize_grid(pixels) if normalize else pixels
