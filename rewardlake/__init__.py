"""rewardlake: rollout and reward analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` or
``Column -> Column``; none holds a global session.
"""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
