"""Spark jobs that turn power readings into appliance on/off intervals, features, models and scores."""
