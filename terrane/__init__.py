"""Spark-native analytics for spatial demand: ingest, calibration, flows, places, analysis."""
