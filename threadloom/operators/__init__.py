"""DataFrame operators on sessions, messages and events."""
