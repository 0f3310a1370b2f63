"""Payload parsers: DataFrame of raw payloads -> DataFrame of source records."""
