"""The feature table fed by Structured Streaming."""
