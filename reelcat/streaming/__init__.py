"""reelcat.streaming."""
