"""Tables that cut lineage: those of the library."""

from ravelin.sources.scratch import CLEANUP, Scratch, shared_dir

__all__ = ["CLEANUP", "Scratch", "shared_dir"]
