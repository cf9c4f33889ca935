"""Part of the integration engine."""
