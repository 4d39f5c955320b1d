"""marlstone: document ingestion, retrieval and evaluation as Spark DataFrame programs."""
