"""Readers of landed tables and writers of the product artefacts."""
