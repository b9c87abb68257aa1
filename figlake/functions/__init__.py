"""Part of figlake."""
