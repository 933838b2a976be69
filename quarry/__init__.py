"""Spark jobs for document knowledge bases, ranked retrieval, conversation streams and the corpora that models are trained on."""
