"""Writers: one CSV folder per sheet, the manifest of a run, and the selection of expired runs."""
