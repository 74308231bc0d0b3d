"""Streaming: files that arrive are ingested as they come; texts expire by event time."""
