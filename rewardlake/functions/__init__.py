"""rewardlake.functions."""
