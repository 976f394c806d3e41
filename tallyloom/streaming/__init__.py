"""Message payloads as streams."""
