"""The tool-call log as a stream.

As in the engine's other ledgers an unrecorded size is never zero, and tools are counted
exactly; a window's state holds its tools' names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import ledgers


def running_tally(log: DataFrame, at: str, session: str, tool: str, size: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Calls, tools and bytes of each session and window; state is dropped once ``late`` has passed."""
    return log.withWatermark(at, late).groupBy(F.window(at, window), session).agg(F.count("*").alias("calls"), F.size(F.collect_set(tool)).cast("long").alias("tools"), ledgers.strict_sum(F.col(size)).alias("bytes")).select(F.col("window.start").alias("window_start"), session, "calls", "tools", "bytes")
