"""Spark jobs that screen many trading track records at once."""

SECONDS_PER_YEAR = 365.25 * 86400.0
