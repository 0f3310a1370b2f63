"""Domain-agnostic DataFrame -> DataFrame operators."""
