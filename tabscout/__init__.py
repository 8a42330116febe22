"""Inspection of messy delimited text at scale, on Spark. See README.md."""
