"""Part of wordloom."""
