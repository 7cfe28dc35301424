"""Meter time-series analytics on Spark DataFrames."""

from heatloom.functions.series import DAILY, HOURLY, Series

__all__ = ["DAILY", "HOURLY", "Series"]
