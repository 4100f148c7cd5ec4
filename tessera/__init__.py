"""tessera: analytics over dense, frame-ordered data, declared as Spark plans."""
