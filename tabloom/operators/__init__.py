"""The table operators."""
