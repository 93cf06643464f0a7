"""Sums over sites that are kept up to date as rows arrive.

Site partials are sums, so a stream can keep them: the state is a row for each site, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import stats
from ..sources.sites import SiteFrame


def running_gram(sf: SiteFrame) -> DataFrame:
    """The cross products of a streaming SiteFrame, in long form."""
    if not sf.df.isStreaming:
        raise ValueError("not a stream")
    return stats.gram(sf)


def keep(df: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Writes a running aggregate to the in-memory table `name` until all that is there has been read."""
    writer = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
