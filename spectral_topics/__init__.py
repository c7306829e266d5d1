"""Topic modelling by the method of moments, as Spark jobs."""

from spectral_topics.plans.model import TopicModel, fit

__all__ = ["TopicModel", "fit"]
