"""Readers and writers: manuscripts, markdown tables, JSONL, frontmatter, configuration."""
