"""Row-wise geometry and colour expressions: Columns in, Columns out."""
