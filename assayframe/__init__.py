"""Analytics for noisy, replicated measurements on Apache Spark.

Every operator takes DataFrames and returns a DataFrame.  The sub-packages are

* ``sources``   scans, sinks, registry dimension, run logs, manifests
* ``functions`` column expressions shared by the operators
* ``operators`` identity, profiling, lookups, run-log checks, metrics, findings
* ``plans``     the operators bound to concrete tables, with their SQL twins
* ``streaming`` row-local log checks over an append-only directory
"""

from assayframe.session import build_session, tune

__all__ = ["build_session", "tune"]
