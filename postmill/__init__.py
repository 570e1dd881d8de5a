"""postmill: a Spark-native engine for job-posting analytics."""
