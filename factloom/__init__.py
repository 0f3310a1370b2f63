"""factloom: set-based analytics over provenance-carrying facts, written for Spark."""
