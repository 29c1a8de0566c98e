"""Wayfare: a combinator query engine on Spark."""
