"""tidemark: subscription-retention analytics as Spark DataFrame operators.

Every operator takes DataFrames plus column names and returns a DataFrame, so
the work stays on the cluster: no driver collects of data, no per-row Python
UDFs in hot paths, no unpartitioned windows.

Sub-packages
------------
sources    table readers/writers, snapshot publish, watermark append, upsert,
           digests, and the churn-shaped fixture views over the driver tables
functions  column-level helpers (risk bands, coercion, text clean-up, ...)
operators  derivations, data-quality checks, reports, worklists, ML
plans      table specs / DDL, the metric-view measure resolver, query catalog
streaming  incremental bronze/silver ingest, expectations, live exclusions
"""

from tidemark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
