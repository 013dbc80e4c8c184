"""Imports every module that registers queries."""

from catalog_queries import (  # noqa: F401
    bindings, changing, checking, learned, linking, reading, reviewing, showing, streaming)  # noqa: F401
