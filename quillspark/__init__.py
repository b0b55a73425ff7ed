"""quillspark: a Spark-native engine for case retrieval, answer evaluation and corpus work."""
