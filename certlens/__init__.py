"""Certificate-transparency analytics on Spark."""
