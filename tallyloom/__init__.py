"""Tallyloom: DataFrame operators for document intelligence on Spark."""
