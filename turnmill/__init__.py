"""turnmill: session analytics and training-data preparation on PySpark DataFrames."""
