"""Part of the engine; see the modules of this package."""
