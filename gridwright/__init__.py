"""Raster-grid cost analysis, least-cost routing and data preparation on PySpark."""
