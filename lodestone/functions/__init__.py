"""lodestone.functions."""
