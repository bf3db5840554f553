"""lectern: scholarly retrieval, entity resolution and evaluation as Spark programs."""
