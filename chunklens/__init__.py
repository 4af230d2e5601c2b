"""chunklens: a PySpark-native chunk-and-retrieve analytics engine.

Sub-packages: ``sources`` (readers, writers), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (named queries
and their SQL counterparts), ``streaming`` (incremental chunking).
"""

__version__ = "0.1.0"
