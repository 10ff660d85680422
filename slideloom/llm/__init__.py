"""Operators for preparing training data: de-duplication, tokens, mixing, filters and redaction.

Nothing else in the library imports this subpackage.  Each module holds one operator with its general
interface; :mod:`slideloom.llm.queries` applies them to whole tables.
"""
