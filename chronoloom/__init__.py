"""Timeline evidence analytics on PySpark: DataFrame in, DataFrame out."""
