"""Outcome-yield analytics on Spark: report labelling, index-event cohorts,
look-back features, grouped evaluation, label audits and case-mix analysis."""

import sys as _sys

__version__ = "0.1.0"

# Python functions shipped to executors (Arrow batch labellers, k-NN scoring,
# feature projection) are serialised by value, so executors need no copy of
# this package on their path.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
