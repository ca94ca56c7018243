"""Part of evalframe; see README.md."""
