"""Incremental refresh of the consolidated table."""
