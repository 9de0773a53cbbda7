"""Palisade: prompt-security analytics over text, code and chat tables, as Spark jobs."""
