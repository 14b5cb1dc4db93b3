"""All queries of the engine over the shared tables, and their SQL."""

from __future__ import annotations

from .plans.chain import CHAINED
from .plans.combined_queries import COMBINED
from .plans.network_queries import NETWORK
from .plans.record_queries import RECORDS
from .plans.series_queries import SERIES, Query
from .plans.stat_queries import STATS
from .plans.stream_queries import STREAMS

ALL: dict[str, tuple[Query, str | None]] = {**SERIES, **STATS, **NETWORK, **COMBINED, **RECORDS, **CHAINED, **STREAMS}
QUERIES: dict[str, Query] = {name: query for name, (query, _) in ALL.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in ALL.items() if sql}
