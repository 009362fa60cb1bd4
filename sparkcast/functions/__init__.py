"""Column-level building blocks: text, numbers, dates and labels."""
