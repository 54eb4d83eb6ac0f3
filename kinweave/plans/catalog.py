"""Named queries over the driver's tables, each beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.plans import discovery, gathering, pools, raw, reconciled, records, stored, strategies

FLAGSHIP = "hybrid_graph"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = discovery.QUERIES | records.QUERIES | pools.QUERIES | raw.QUERIES | gathering.QUERIES | reconciled.QUERIES | stored.QUERIES | strategies.QUERIES
ORACLES: dict[str, str] = discovery.ORACLES | records.ORACLES | pools.ORACLES | raw.ORACLES | gathering.ORACLES | reconciled.ORACLES | stored.ORACLES | strategies.ORACLES
