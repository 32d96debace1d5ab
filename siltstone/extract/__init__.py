"""From bytes to lines: one function per format, run as ``mapInPandas``."""

from siltstone.extract.registry import Registry, default_registry, extract_files

__all__ = ["Registry", "default_registry", "extract_files"]
