"""Spark-first packet, signal and evidence analytics."""
