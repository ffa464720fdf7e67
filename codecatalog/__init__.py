"""codecatalog: documentation tables for source-code corpora, computed as Spark jobs."""
