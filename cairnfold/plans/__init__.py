"""Whole analyses, from records to verdicts."""
