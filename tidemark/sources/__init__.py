"""Reading landed feeds and writing tables."""
