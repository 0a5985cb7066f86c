"""Spatial map algebra, terrain, proximity, validation and auditing as Spark DataFrame operators."""
