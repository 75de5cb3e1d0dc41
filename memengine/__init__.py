"""memengine: Spark-first analytics over agent memories."""
