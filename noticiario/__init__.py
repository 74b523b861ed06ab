"""Spark-native building and analysis of regional news corpora.

Sub-packages
------------
functions   column expressions: dates, URLs, text
sources     dimension tables, readers and writers
operators   DataFrame -> DataFrame transformations
plans       user-level jobs composed from the operators
streaming   incremental arrival with Structured Streaming
"""

from noticiario.session import configure, session

__all__ = ["configure", "session"]
