"""docfacts: documents to facts to statistics, as Spark jobs."""
