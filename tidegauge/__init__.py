"""Time-series analytics on Spark DataFrames.

Every operator is a plain function from DataFrames to a DataFrame, so operators compose
with ordinary Spark code and Catalyst sees one logical plan.
"""

from tidegauge.schema import SeriesSchema, infer_schema
from tidegauge.session import build_session, configure

__all__ = ["SeriesSchema", "build_session", "configure", "infer_schema"]
