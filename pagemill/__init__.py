"""Page-to-Markdown corpus engine on Spark."""
