"""Part of tamga."""
