"""Part of lenswright."""
