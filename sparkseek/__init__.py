"""sparkseek: text retrieval, vector search and training-data curation on Spark DataFrames."""
