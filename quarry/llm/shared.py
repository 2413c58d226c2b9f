"""Cuts of lineage, for the operators of this subpackage."""

from quarry.lineage import cut, shared_dir

__all__ = ["cut", "shared_dir"]
