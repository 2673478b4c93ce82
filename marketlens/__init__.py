"""marketlens: trend analytics over (entity, period, value) tables on Spark.

Every operator is a DataFrame -> DataFrame function whose column names are
parameters. Sub-packages:

- ``functions``: column expressions (labels, text, numbers, dates, JSON).
- ``sources``: file scans and sinks (CSV series, glossary TSV, posting files,
  attempt logs, run store).
- ``operators``: aggregations, period series, windows, merges, forecasting.
- ``plans``: bindings of the operators to concrete tables.
- ``streaming``: Structured Streaming forms of ingest and period counts.
"""

__version__ = "0.1.0"

# Python workers (pandas UDFs, mapInPandas, applyInPandas) receive this
# package's functions by value, so executors do not need it installed.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
