"""Part of the recommendation-analytics engine."""
