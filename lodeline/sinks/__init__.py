"""Sinks: reports, graph exports, changes to source trees."""
