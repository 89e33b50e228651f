"""Scans and matches as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def new_scans(scans: DataFrame, time: str, delay: str) -> DataFrame:
    """Each (file, scan) once, though instruments repeat rows within the delay."""
    return scans.withWatermark(time, delay).dropDuplicatesWithinWatermark(["file", "scan"])


def intensity_by_window(scans: DataFrame, time: str, delay: str, length: str, slide: str | None = None) -> DataFrame:
    """Scans, mean and highest value in tumbling (or sliding) windows by scan type; late rows within the delay count."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return scans.withWatermark(time, delay).groupBy(window.alias("window"), "scan_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select("window.start", "window.end", "scan_type", "n", "mean", "most")


def running_top_k(matches: DataFrame, k: int) -> DataFrame:
    """The k best matches so far of each scan whenever it gets new ones. matches: scan long, peptide string, score double."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            best += zip(f["score"].tolist(), f["peptide"].tolist(), strict=True)
        best = sorted(set(best), key=lambda x: (-x[0], x[1]))[:k]
        state.update(([x[0] for x in best], [x[1] for x in best]))
        yield pd.DataFrame({"scan": key[0], "rank": range(1, len(best) + 1), "peptide": [x[1] for x in best], "score": [x[0] for x in best]})

    return matches.groupBy("scan").applyInPandasWithState(update, "scan long, rank int, peptide string, score double", "scores array<double>, peptides array<string>", "update", "NoTimeout")
