"""Fuzzy rule learning and scoring on Spark DataFrames.

Two-class, interpretable IF-THEN rule bases learned from fuzzy grid cells,
short sub-rules, conflict resolution and pruning; every step is a
DataFrame -> DataFrame operator.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# UDF code of this package travels inside the task closure, so executors
# need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from fuzzrule.params import RuleParams  # noqa: E402
from fuzzrule.plans.learner import RuleModel, learn  # noqa: E402

__all__ = ["RuleModel", "RuleParams", "learn"]
