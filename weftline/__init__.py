"""Weftline: people-to-item matching and data processing as Spark plans."""
