"""DataFrame -> DataFrame operators of the rule learner."""
