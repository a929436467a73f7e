"""Channel counts per ip and hour, ip and app, ip, app and os."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmill.functions.clock import day_of_month, hour_of_day
from clickmill.operators.frames import Total, add_needs, choose_strategies, hidden
from clickmill.operators.lookup import CHUNK_ROWS, with_chunk

COUNTS = {
    "n_channels": ["ip", "_day", "_hour"],
    "ip_app_count": ["ip", "app"],
    "ip_app_os_count": ["ip", "app", "os"],
}


def add_basic_counts(clicks: DataFrame, strategy: str = "auto", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each click gets the number of (non-null, not distinct) channels of its three groups."""
    if strategy == "auto":
        strategy = choose_strategies(clicks, [("ip",)])[0][0]
    rows = with_chunk(clicks, chunk_rows).withColumns(
        {"_day": day_of_month(F.col("click_s")), "_hour": hour_of_day(F.col("click_s"))}
    )
    source = rows
    rows = rows.repartition("ip" if strategy == "direct" else "chunk")
    for name, keys in COUNTS.items():
        rows = add_needs(rows, name, keys, [Total("channels")], strategy, source)
        rows = rows.select("*", F.col(hidden(Total("channels"), name)).cast("int").alias(name))
    return rows.select(*clicks.columns, *COUNTS)
