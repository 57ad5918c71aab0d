"""Image and text writers."""
