"""Demultiplexing of long sequencing reads, as Spark DataFrames."""
