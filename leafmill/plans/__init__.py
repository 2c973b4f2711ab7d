"""Jobs put together: building the corpus, retrieving evidence, taking conversation turns."""
