"""The published tables and the reports built on them."""
