"""Dataset-level operators: DataFrame in, DataFrame out."""
