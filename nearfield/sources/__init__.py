"""Point readers, checks and result writers."""
