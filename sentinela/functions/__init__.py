"""Column-level building blocks: calendar, laboratory results, scalars."""
