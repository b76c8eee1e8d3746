"""Models as text and Parquet files."""
