"""Column-level building blocks: calendar, text, weather, arrays, order statistics."""
