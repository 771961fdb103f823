"""Table operators: DataFrame in, DataFrame out, nothing computed on the driver."""
