"""Review-tagging analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run in Python workers travel with the job; executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tagweave.operators.replies import rerank  # noqa: E402
from tagweave.operators.scoring import predict_by_group  # noqa: E402
from tagweave.plans.tagging import consolidate_pool, evaluate, predict_tags, prepare_dataset  # noqa: E402
from tagweave.sources.artifacts import Artifacts, load_artifacts, save_artifacts  # noqa: E402

__all__ = [
    "Artifacts", "consolidate_pool", "evaluate", "load_artifacts", "predict_by_group",
    "predict_tags", "prepare_dataset", "rerank", "save_artifacts",
]
