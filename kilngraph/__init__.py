"""kilngraph: a Spark-first knowledge-graph analytics engine."""
