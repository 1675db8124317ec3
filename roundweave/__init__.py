"""Trajectory refinement as Spark DataFrame operators."""
