"""Reading and writing of corpus tables."""
