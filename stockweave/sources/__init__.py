"""Readers, writers, the dataset registry and the canonical model build."""
