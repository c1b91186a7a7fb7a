"""tuneframe: post-training data preparation and rollout analytics on Spark."""

import sys as _sys

__version__ = "0.1.0"

# Python functions the library hands to Spark (the packing planner, streaming
# state functions, pandas UDF wrappers) are pickled by value, so executors do
# not need the package installed or on their path.
try:  # pragma: no cover - depends on the bundled cloudpickle version
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
