"""newsloom: Spark-native analytics for news-like text corpora and small time series."""
