"""Document-evidence analytics on Spark: ingest, retrieve, ground, evaluate, classify, observe."""
