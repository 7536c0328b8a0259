"""The dial plan: numbering rules of regions and of codes without a region."""

from callgrid.plans.loader import Plan, default_plan

__all__ = ["Plan", "default_plan"]
