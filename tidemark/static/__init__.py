"""Source code as facts: one pass a file makes rows, rules are joins over them."""
