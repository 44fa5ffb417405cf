"""rowtide: change-data replication, reconciliation and pipeline audit on Spark.

Everything is a plain function from DataFrames to DataFrames; the sub-packages are

``functions``   column expressions (names, positions, labels, types)
``sources``     tables, change logs, snapshots, option presets
``operators``   transforms, apply/merge, dead letters, reconcile, audit, telemetry
``streaming``   the same work on Structured Streaming
``plans``       queries over the benchmark tables, each with its SQL counterpart
"""

__version__ = "0.1.0"
