"""Text-and-market analytics for PySpark: DataFrame in, DataFrame out."""
