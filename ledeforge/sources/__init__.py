"""Sources and sinks: feeds, market data, preferences, settings."""
