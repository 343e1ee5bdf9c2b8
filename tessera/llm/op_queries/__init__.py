"""One module per op query."""
