"""fogbank: a Spark-native engine for forecast post-processing over a bronze/silver/gold lake."""
