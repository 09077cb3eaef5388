"""corpusflow: document evidence retrieval, array-expression analytics and corpus preparation as PySpark jobs."""
