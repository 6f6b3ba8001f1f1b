"""rewardlake.sources."""
