"""Cleaning plans: chains of operators driven by a configuration."""
