"""The full run on many datasets, with a status for each."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.plans.report import Report, Settings, analyze
from shoal.sources.csv import load_csv_folder

BATCH_SETTINGS = Settings(n_trials=10)
_STATUS = "dataset string, status string, error string, kmeans_k int, hierarchical_k int"


@dataclass(frozen=True)
class BatchResult:
    """``status`` has one row per dataset; ``reports`` holds the runs that succeeded."""

    status: DataFrame
    reports: Mapping[str, Report] = field(repr=False)

    def table(self, name: str) -> DataFrame:
        """One report table of all datasets, keyed by ``dataset``; its columns may differ."""
        parts = [r.tables[name] for r in self.reports.values()]
        keyed = [p if "dataset" in p.columns else p.select(F.lit(n).alias("dataset"), "*")
                 for n, p in zip(self.reports, parts)]
        out = keyed[0]
        for part in keyed[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out


def analyze_batch(spark: SparkSession, datasets: Mapping[str, DataFrame], settings: Settings = BATCH_SETTINGS,
                  fail_fast: bool = False, at_once: int = 2) -> BatchResult:
    """Run :func:`analyze` on every dataset with the same settings.

    A failing dataset is recorded and the others go on, unless ``fail_fast``. A few runs are
    submitted together, so that the small jobs of one fill the gaps of another.
    """
    if not datasets:
        raise ValueError("no datasets to analyse")
    reports: dict[str, Report] = {}

    def run(name: str) -> tuple:
        try:
            report = analyze(datasets[name], settings, name)
        except Exception as problem:
            if fail_fast:
                raise
            return name, "failed", str(problem) or repr(problem), None, None
        reports[name] = report
        return name, "completed", None, report.analysis.kmeans_k, report.analysis.hierarchical_k

    names = list(datasets)
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        status = list(pool.map(inheritable_thread_target(spark)(run), names))
    return BatchResult(spark.createDataFrame(status, _STATUS), {n: reports[n] for n in names if n in reports})


def analyze_folder(spark: SparkSession, folder: str, settings: Settings = BATCH_SETTINGS,
                   fail_fast: bool = False, at_once: int = 2) -> BatchResult:
    """Run the batch on every CSV file below ``folder``, keyed by full path."""
    return analyze_batch(spark, load_csv_folder(spark, folder), settings, fail_fast, at_once)
