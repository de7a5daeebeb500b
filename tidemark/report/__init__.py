"""Findings as JSON, SARIF, Markdown and plain text. Findings are few; they are collected once."""
