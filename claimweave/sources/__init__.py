"""Readers for claims tables, code lists and calendars, and the stage-table writer."""
