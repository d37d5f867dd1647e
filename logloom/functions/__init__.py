"""Column helpers: text, JSON admission, time and variant access."""
