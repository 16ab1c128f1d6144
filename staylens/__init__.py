"""Reservation analytics on Spark: cleaning, queries, edits, scoring and streams."""
