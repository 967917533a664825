"""Readers of labelled files and stored artifacts."""
