"""What a Spark job may fail with, and how to tell it."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

#: Failures of planning and running; a lost connection to Spark is none of them.
FAILURES = (PySparkException, Py4JJavaError)


def failure(why: Exception, most: int = 500) -> str:
    """The failure with its kind, so that a lost executor is not taken for wrong data."""
    if isinstance(why, Py4JJavaError):
        cause = why.java_exception
        return f"{cause.getClass().getSimpleName()}: {cause.getMessage()}"[:most]
    return f"{type(why).__name__}: {why}"[:most]
