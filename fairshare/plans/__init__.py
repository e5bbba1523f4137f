"""Whole pipelines: raw frames to the tables that are served."""
