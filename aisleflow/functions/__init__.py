"""Column-level functions: divide rules, text rules, calendar parts."""
