"""Package of evisparq."""
