"""A Spark-native engine for collections of web pages and link graphs."""
