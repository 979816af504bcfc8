"""Behavioural-event evidence pipeline expressed as Spark jobs."""
