"""Panoramic splat analytics on PySpark: rasters and 3D Gaussians as tables."""
