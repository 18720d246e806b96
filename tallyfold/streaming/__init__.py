"""Streams: the library forecasts in batches; a rolling origin is a column, so nothing here keeps state."""
