"""Composable DataFrame operators: splitting, scoring, numbering, joining."""
