"""Lodestone: team-knowledge and training-data analytics as Spark DataFrame programs."""
