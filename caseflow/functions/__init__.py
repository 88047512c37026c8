"""caseflow package."""
