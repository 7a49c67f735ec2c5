"""tessera: a full-text search and corpus-processing engine expressed as Spark plans."""
