"""Reading corpora and publishing datasets."""
