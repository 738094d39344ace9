"""Structured Streaming: analysis again as sources change."""
