"""Tables the operators read: literals, parquet inputs and the views bound to them."""
