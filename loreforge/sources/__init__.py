"""Files in and out of the store."""
