"""docloom: a Spark-native engine for document retrieval, evaluation and corpus preparation."""
