"""Analytics over a media catalogue, as DataFrame operations."""
