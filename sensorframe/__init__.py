"""Sensor-recording analytics on Spark DataFrames."""
