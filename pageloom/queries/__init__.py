"""One query for each operator over the tables, and its SQL for another engine.

No table holds PDF files, so others stand in: a conversation is a document and its turns are pages, parts are images,
events are edits. A query shows that an operator is right on such rows, not that bytes of a file would agree.
"""

from . import annotations, insertions, logs, media, names, pages, streams

MODULES = (pages, insertions, names, media, annotations, logs, streams)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
