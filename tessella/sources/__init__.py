"""Tables in and out: Parquet and CSV."""
