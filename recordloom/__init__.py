"""recordloom: a Spark-native analytics engine for record collections."""
