"""Readers and writers for survey files, codebooks and result tables."""
