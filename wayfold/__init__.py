"""Spatial road-network analytics as DataFrame programs."""
