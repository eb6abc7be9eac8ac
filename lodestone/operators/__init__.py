"""lodestone.operators."""
