"""A Spark-native engine for quantitative research and fund simulation."""
