"""Part of loomstream; see README.md."""
