"""Readers of training/test tables and writers of result tables."""
