"""The row-wise validation on a stream."""
