"""Edgeloom: link-prediction analytics on timestamped graphs, written as Spark DataFrame jobs."""
