"""docloom: document-field analytics and corpus preparation as PySpark jobs."""
