"""tidewater: maritime-traffic analytics as Spark DataFrame / Structured Streaming / MLlib jobs."""

__all__ = ["session", "config"]
