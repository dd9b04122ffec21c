"""Millrace: DataFrame operators for vulnerability records, text, events and predictions on Spark."""
