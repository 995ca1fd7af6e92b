"""Queries of resumable work."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.operators.common import scratch
from quakeframe.plans.registry import query
from quakeframe.streaming.incremental import UpsertTable, pending


@query("""select event_id from evt where event_id not in (select event_id from evt where event_id % 4 = 1)""")
def pending_events(t):
    """Events that are not done yet."""
    return pending(t("evt"), t("evt").filter("event_id % 4 = 1"), ["event_id"]).select("event_id")


@query("""select event_id, case when event_id % 3 = 0 then 2 else 1 end as version from evt where event_id % 2 = 0 or event_id % 3 = 0""")
def merged_catalog(t):
    """Two batches merged into a table in versions: the newer row of an event stays."""
    table = UpsertTable(t.spark, scratch(t.spark, "catalog"), ["event_id"], ["version"], "event_id long, version int")
    for version, every in ((1, 2), (2, 3)):
        table.merge(t("evt").filter(F.col("event_id") % every == 0).select(F.col("event_id").cast("long"), F.lit(version).alias("version")))
    return table.read()
