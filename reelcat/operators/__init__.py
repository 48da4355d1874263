"""reelcat.operators."""
