"""Named queries of the training-data operators."""
