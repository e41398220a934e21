"""weft: corpus analytics and training-data preparation on PySpark DataFrames."""
