"""Where tables come from: Parquet, text bitmaps and the derived example tables."""
