"""Kifu Spark: analytics over ordered event records, written as Spark plans."""
