"""Document retrieval as Spark jobs: ingest, chunk, embed, rank and assemble answer contexts."""
