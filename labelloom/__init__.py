"""Text-classification experiments as Spark jobs.

Corpus preparation, class-balanced sampling, TF-IDF and embedding features,
model fitting and tuning, batch inference behind a content-keyed cache,
evaluation, and comparison of runs, all on DataFrames.
"""

import sys

from pyspark import cloudpickle

from labelloom.session import build_session, fresh_path, materialize, shared_dir, small_table

__all__ = ["build_session", "fresh_path", "materialize", "shared_dir", "small_table"]

# Functions that run in tasks travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
