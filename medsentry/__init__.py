"""PySpark-native drug-safety signal engine.

Subpackages: ``sources`` (readers and file discovery), ``functions`` (Column-level scalar
functions), ``operators`` (joins, deduplication, contingency, estimators), ``plans`` (whole
queries and runs) and ``streaming`` (continuous ingest).
"""

__version__ = "0.1.0"
