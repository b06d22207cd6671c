"""Relational operators: extraction, truth building, decisions, linking, gates, row rejection, orphans."""
