"""Readers and writers of the formats that datasets and results come in."""
