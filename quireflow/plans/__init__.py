"""End-to-end plans: capture, clean, book, check and report."""
