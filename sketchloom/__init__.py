"""Binary-sketch similarity search on Spark: hyperplane sketches, exact and cascaded search, a popcount index, recall."""
