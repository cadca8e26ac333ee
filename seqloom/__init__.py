"""seqloom: Spark jobs over symbol sequences, class discovery and log-linear scoring."""
