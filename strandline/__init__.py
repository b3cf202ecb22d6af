"""Spark DataFrame operators for evidence-driven molecular annotation tables."""
