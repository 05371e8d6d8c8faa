"""A full run on one table: preprocess, choose K, train, and collect the report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators.columns import shape_summary
from shoal.operators.quality import MAX_PAIRS
from shoal.operators.statistics import correlation_matrix
from shoal.plans.analyze_k import KAnalysis, analyze_k
from shoal.plans.preprocess import Preprocessed, preprocess
from shoal.plans.train import ClusteringResult, run_clustering
from shoal.session import materialise
from shoal.sources.results import write_results


@dataclass(frozen=True)
class Settings:
    """Options of a run. ``micro`` replaces the rows by weighted micro-clusters where the exact
    method is quadratic; it has to be asked for, since it is an approximation."""

    drop_cols: Sequence[str] = ()
    imputer: str = "mean"
    scaler: str = "standard"
    remove_outliers: bool = True
    n_trials: int = 1
    linkage: str = "ward"
    weights: Mapping[str, int] | None = None
    seed: int = 42
    micro: int | None = None
    max_pairs: int | None = MAX_PAIRS


@dataclass(frozen=True)
class Report:
    """Everything a run produced; ``tables`` are the ones a report shows. Correlations are those of the raw table."""

    name: str
    raw: DataFrame = field(repr=False)
    preprocessed: Preprocessed = field(repr=False)
    rows: DataFrame = field(repr=False)
    analysis: KAnalysis = field(repr=False)
    result: ClusteringResult = field(repr=False)
    shape: DataFrame = field(repr=False)

    @property
    def tables(self) -> dict[str, DataFrame]:
        names = self.preprocessed.columns
        processed = self.rows.select("row_id", *[
            F.col("features")[i].alias(n) for i, n in enumerate(names)])
        return {
            "shape": self.shape, "processed_data": processed, "k_metrics_detail": self.analysis.detail,
            "k_curves": self.analysis.curves, "correlation": correlation_matrix(self.raw),
            "projection": self.result.projection,
            "voting_history": self.analysis.history, "metrics": self.result.metrics,
            "profile_kmeans": self.result.profile_kmeans,
            "profile_hierarchical": self.result.profile_hierarchical}

    def write(self, folder: str, format: str = "csv") -> dict[str, str]:
        """Write the report tables below ``folder``."""
        return write_results(self.tables, folder, format)


def analyze(df: DataFrame, settings: Settings = Settings(), name: str = "dataset",
            key: str | None = None) -> Report:
    """Preprocess a table, suggest K, and train both models with the suggestion.

    Rows get an id, once, when the processed table is written to the shared folder, unless
    ``key`` names a unique BIGINT column.
    """
    pre = preprocess(df, settings.drop_cols, settings.imputer, settings.scaler,
                     settings.remove_outliers, key=[key] if key else [])
    empty = [n for n in pre.numeric if pre.stats[n].count == 0]
    if empty:
        raise ValueError(f"no values in column {empty[0]!r}")
    row_id = F.col(f"`{key}`").cast("long") if key else F.monotonically_increasing_id()
    rows = materialise(pre.rows.select(row_id.alias("row_id"), "profile", "features"), "rows")
    analysis = analyze_k(rows, settings.n_trials, settings.weights, seed=settings.seed,
                         micro=settings.micro, max_pairs=settings.max_pairs)
    result = run_clustering(rows, analysis.kmeans_k, analysis.hierarchical_k, settings.linkage,
                            settings.seed, sweep=analysis.sweep, micro=settings.micro,
                            max_pairs=settings.max_pairs)
    shape = shape_summary({"raw": df, "processed": rows}).withColumn(
        "n_cols", F.when(F.col("name") == "processed", F.lit(len(pre.columns)).cast("long"))
        .otherwise(F.col("n_cols"))).select(F.lit(name).alias("dataset"), "*")
    return Report(name, df, pre, rows, analysis, result, shape)
