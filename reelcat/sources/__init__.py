"""reelcat.sources."""
