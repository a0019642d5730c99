"""Spark analytics for page-text recognition results: segmentation, scoring, density features and collapse models."""
