"""textpulse: Spark-native analytics for comment and chat streams.

Layout: ``functions`` (column expressions), ``sources`` (tables, record envelopes, word lists),
``operators`` (DataFrame -> DataFrame jobs), ``sinks`` (table store, publishing),
``streaming`` (Structured Streaming queries), ``plans`` (the registered queries).
"""

import sys as _sys

__version__ = "0.1.0"

# Functions and classes of this package that run in Python workers (pandas UDFs, mapInPandas
# functions, stateful processors) are pickled by value, so executors need no installed copy
# of the package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without by-value registration
    pass
