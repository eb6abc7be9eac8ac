"""lodestone.streaming."""
