"""lumenframe: media-library analytics and planning on PySpark DataFrames."""
