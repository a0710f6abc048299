"""vigil — metric anomaly analytics on Spark.

Metric points (batch tables or Structured Streaming sources) are validated,
split into time series and scored by a per-series sliding-window
median / median-absolute-deviation detector. Anomalies are encoded in a
versioned JSON envelope, decoded, de-duplicated, appended to an event table
and folded into a latest-state-per-series table that serves paged reads.

Everything is expressed with DataFrame operations so that Catalyst plans it;
Python runs only inside Arrow-batched pandas UDFs and the streaming state
processor.
"""

from vigil.config import MadConfig
from vigil.session import get_spark, checkpoint_dir

__all__ = ["MadConfig", "get_spark", "checkpoint_dir"]
