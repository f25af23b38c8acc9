"""Plans: chains of estimators, and saving them."""
