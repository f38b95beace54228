"""Column functions: identifiers, text, dates and rule cascades."""
