"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage; it registers its own
queries (:mod:`tidemill.llm.queries`)."""
