"""Knowledge and retrieval analytics on Spark: documents, a typed graph, search, and their upkeep."""
