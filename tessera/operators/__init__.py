"""DataFrame → DataFrame operators: profile, correlation, sampling, target, features, metrics, models."""
