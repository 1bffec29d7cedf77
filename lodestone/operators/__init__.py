"""operators of lodestone."""
