"""rewardlake.streaming."""
