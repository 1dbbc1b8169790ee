"""A Spark-native engine for agent memories: storage, retrieval, curation and audit as DataFrame plans."""
