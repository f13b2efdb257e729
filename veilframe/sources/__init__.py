"""Readers: sheets from tables and files, workbook files, input screening."""
