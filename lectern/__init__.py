"""lectern: a Spark-native analytics engine for timed-text archives."""
