"""Factory telemetry analytics and predictive maintenance on Spark."""
