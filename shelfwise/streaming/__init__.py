"""Event operators: batch forms and their Structured Streaming forms."""
