"""Discrete belief networks over Spark DataFrames: counting, estimation, scoring, structure search and inference."""

from .network import Model, Network, Variable

__all__ = ["Model", "Network", "Variable"]
