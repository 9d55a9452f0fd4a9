"""docgraph: Spark batch jobs that turn document collections into an evidence graph and query it."""
