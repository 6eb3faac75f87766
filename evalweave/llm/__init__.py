"""Operators for preparing training data; see ``evalweave.llm.queries`` for the registered queries."""
