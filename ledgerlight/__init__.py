"""ledgerlight: retail sales analytics and forecasting as lazy Spark DataFrame jobs.

Layout
------
sources/    table readers, the raw flat sales table, sinks, holiday calendars
functions/  column expressions (pseudonyms, calendar fields, safe maths, formats)
operators/  DataFrame -> DataFrame building blocks (ingest, clean, daily,
            series windows, quantiles, reports, forecasting, ensemble)
plans/      served queries and the end-to-end pipeline composed from operators
streaming/  the daily aggregate over a file stream
"""

from ledgerlight.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
