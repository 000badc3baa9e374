"""Conversation analytics as Spark DataFrame operators.

Every operator is a lazy ``DataFrame(s) -> DataFrame`` function keyed by
``(run, conv_index)``. Times are BIGINT milliseconds until the output column.
"""

__version__ = "0.1.0"
