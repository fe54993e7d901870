"""Part of the tessera engine."""
