"""millrace: a Spark-first engine for process-quality analytics and corpus preparation."""
