"""Query parsing, algebra and compilation."""
