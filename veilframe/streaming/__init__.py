"""The per-row and per-key operators on unbounded input."""
