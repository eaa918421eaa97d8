"""Part of siltloom."""
