"""Spark-native analytics for labelled command logs.

Sub-packages
------------
``sources``    scans and sinks (JSONL, lines, Parquet, nested documents)
``functions``  column expressions (text, label vectors, decisions)
``operators``  DataFrame -> DataFrame building blocks
``plans``      end-to-end jobs and the query catalogue with its SQL twins
``streaming``  the line-stream form of the scoring job
"""

__version__ = "0.1.0"
