"""Knowledge graphs from documents, built and asked with Spark DataFrames."""
