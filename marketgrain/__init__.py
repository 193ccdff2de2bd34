"""Marketplace analytics as Spark jobs: grain-safe order tables, marts, questions and models."""

from marketgrain.plans.marketplace import Marketplace
from marketgrain.session import marketplace_session

__all__ = ["Marketplace", "marketplace_session"]
