"""Ready-made queries, and stages that are configured by name."""
