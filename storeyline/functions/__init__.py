"""Part of storeyline."""
