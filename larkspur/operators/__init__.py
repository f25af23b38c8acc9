"""Operators: estimators with fit, models with transform or predict, metrics and samplers."""
