"""Single-purpose operators: DataFrame in, DataFrame out."""
