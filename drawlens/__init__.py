"""Set-sequence analytics on Spark: see README.md."""
