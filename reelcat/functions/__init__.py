"""reelcat.functions."""
