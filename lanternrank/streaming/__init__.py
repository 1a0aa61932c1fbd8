"""The embedding step over record files as they arrive."""
