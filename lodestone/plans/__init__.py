"""lodestone.plans."""
