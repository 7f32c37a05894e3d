"""Columns built from columns."""
