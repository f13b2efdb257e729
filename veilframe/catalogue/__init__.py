"""The query catalogue: derived sheets, the registered queries and their SQL oracle."""
