"""corpusflow: Spark jobs that build, maintain, search and evaluate text corpora."""
