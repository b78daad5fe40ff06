"""Operators put together into the batch run."""
