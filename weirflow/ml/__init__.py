"""Models over feature columns."""
