"""Annotated multichannel time series as lazy PySpark plans."""
