"""Operators over DataFrames: graphs, liveness, ordered groups, resolution, snapshots."""
