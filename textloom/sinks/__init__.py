"""Writers and the payloads they store."""
