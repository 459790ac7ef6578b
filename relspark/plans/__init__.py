"""From query contexts to DataFrames and to SQL text."""
