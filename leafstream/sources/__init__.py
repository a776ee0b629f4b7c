"""Part of the leafstream engine."""
