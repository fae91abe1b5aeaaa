"""All plans: importing the modules registers their queries."""

from __future__ import annotations

from . import relational, retrieval, structure, textual  # noqa: F401, I001
from . import library, modelled, streams, wording  # noqa: F401, I001
from .catalog import ORACLE_SQL, QUERIES  # noqa: F401
