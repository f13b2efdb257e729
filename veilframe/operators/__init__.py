"""Table operators: clean, number, look up, score, detect, preview, audit."""
