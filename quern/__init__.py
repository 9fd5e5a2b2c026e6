"""quern: Spark-native corpus, series and graph analytics over DataFrames."""
