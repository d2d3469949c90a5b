"""loomspan: a Spark-first engine for record linkage, panels and estimators."""
