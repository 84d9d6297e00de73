"""Reading and writing review tables, embedding stores and result files."""
