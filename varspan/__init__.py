"""Interval-shaped analytics on Spark: DataFrame-to-DataFrame operators for variant calls, tracks and cohorts."""
