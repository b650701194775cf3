"""Evaluation evidence as Spark tables: every operator is DataFrame in, DataFrame out."""
