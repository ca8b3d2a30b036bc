"""siltstone: log-structured key-value analytics and training-data operators on Spark.

Sub-packages: ``sources`` (tables, logs, runs), ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame), ``streaming`` (micro-batch jobs) and
``plans`` (the named queries and their SQL counterparts).
"""

__version__ = "0.1.0"
