"""Analytics on batches of label images, as DataFrame plans."""
