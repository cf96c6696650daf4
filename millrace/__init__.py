"""Code-corpus analytics on Spark."""
