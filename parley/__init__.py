"""Conversational-commerce analytics on Spark DataFrames.

Every operator takes DataFrames (or a mapping of table name to DataFrame) and
returns a DataFrame; nothing is executed until the caller runs an action.
"""
