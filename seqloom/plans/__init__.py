"""Sweep planning and comparison over tables of run specifications."""
