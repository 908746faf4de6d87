"""Part of the statement-context engine."""
