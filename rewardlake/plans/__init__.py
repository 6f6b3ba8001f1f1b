"""rewardlake.plans."""
