"""rewardlake.operators."""
