"""Part of vecatlas."""
