"""clausework: a Spark-native engine that turns document text into a traceable, queryable knowledge base."""
