"""lectern: a Spark-native learning-analytics and course-corpus engine."""
