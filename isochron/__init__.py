"""Spark operators for labelled, grouped event series and their evaluation."""
