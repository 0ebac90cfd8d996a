"""Record analytics on Spark: sources, record operators, plans and streaming upserts."""
