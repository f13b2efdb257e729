"""Rule sets and the column plans derived from them."""
