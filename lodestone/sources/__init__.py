"""lodestone.sources."""
