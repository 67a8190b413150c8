"""Intermediate tables in the folder that the cluster shares: those of the whole library."""

from strandloom.scratch import Scratch, clean, shared_folder

__all__ = ["Scratch", "clean", "shared_folder"]
