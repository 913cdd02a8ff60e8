"""Stages of the curation chain, each a function from DataFrames to DataFrames; the caller decides on sinks."""
