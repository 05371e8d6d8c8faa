"""Clustering analysis of large tables on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks travel whole, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from shoal.operators.agglomerative import Dendrogram, agglomerative  # noqa: E402
from shoal.operators.choose_k import (  # noqa: E402
    best_k, consensus, k_detail, kneedle, voting_history, weighted_vote)
from shoal.operators.cleaning import drop_missing, impute, label_encode, scale, zscore_filter  # noqa: E402
from shoal.operators.columns import assemble, drop_columns, preview, shape_summary  # noqa: E402
from shoal.operators.kmeans import assign_nearest, kmeans, kmeans_groups, kmeans_many, lloyd  # noqa: E402
from shoal.operators.micro import compress, micro_clusters  # noqa: E402
from shoal.operators.pca import pca, pca_groups, projection, stratified_sample  # noqa: E402
from shoal.operators.quality import (  # noqa: E402
    adjusted_rand, silhouette_squared,
    calinski_harabasz, davies_bouldin, score, silhouette)
from shoal.operators.statistics import cluster_profile, correlation_matrix  # noqa: E402
from shoal.session import release  # noqa: E402
from shoal.plans.analyze_k import analyze_k, k_sweep  # noqa: E402
from shoal.plans.batch import analyze_batch, analyze_folder  # noqa: E402
from shoal.plans.grouped import preprocess_groups  # noqa: E402
from shoal.plans.group_fits import GroupFits, fit_groups  # noqa: E402
from shoal.plans.preprocess import Preprocessed, load_preprocessed, preprocess  # noqa: E402
from shoal.plans.report import Report, Settings, analyze  # noqa: E402
from shoal.plans.train import run_clustering  # noqa: E402
from shoal.sources.csv import infer_types, load_csv, load_csv_folder, load_csv_tables  # noqa: E402
from shoal.sources.results import read_results, write_results  # noqa: E402

__all__ = [
    "GroupFits", "adjusted_rand", "fit_groups", "load_preprocessed", "pca_groups", "silhouette_squared", "stratified_sample",
    "Dendrogram", "Preprocessed", "Report", "Settings", "agglomerative", "analyze", "analyze_batch",
    "analyze_folder", "analyze_k", "assemble", "assign_nearest", "best_k", "calinski_harabasz",
    "cluster_profile", "compress", "consensus", "correlation_matrix", "davies_bouldin", "drop_columns",
    "drop_missing", "impute", "infer_types", "k_detail", "k_sweep", "kmeans", "kmeans_groups", "kmeans_many", "kneedle",
    "label_encode", "lloyd", "load_csv", "load_csv_folder", "load_csv_tables", "micro_clusters", "pca", "preprocess", "preprocess_groups",
    "preview", "projection", "read_results", "release", "run_clustering", "scale", "score", "shape_summary",
    "silhouette", "voting_history", "weighted_vote", "write_results", "zscore_filter"]
