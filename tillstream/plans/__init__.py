"""Composite jobs: the event pipeline, the metric registry and the report."""
