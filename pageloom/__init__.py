"""Paginated documents as Spark tables: page algebra, insertion planning, media accounting, annotation edits."""
