"""A Spark-native engine for verifiable memory: hash chains, replay, exact recall, evidence."""
