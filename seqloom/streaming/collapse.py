"""Collapse of reads that arrive as a stream: running counts of distinct sequences by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators import collapse


def running_counts(reads: DataFrame, samples: int, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts of a stream of (sample, name, seq, qual) in the memory table ``name``; state survives restarts."""
    counted = collapse.counts(collapse.long_enough(collapse.normalised(reads)), samples)
    return counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
