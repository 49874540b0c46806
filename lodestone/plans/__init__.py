"""Registered queries over the standard tables, with their SQL."""

from lodestone.plans import chat_queries, curation_queries, formula_queries, mechanism_queries, more_queries, speech_queries, sql_queries, stream_queries, table_queries, text_queries, tool_data_queries, tool_queries  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES  # noqa: F401
