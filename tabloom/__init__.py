"""Table operators for Spark: whole DataFrame in, whole DataFrame out."""
