"""Column functions: vocabulary, scoring, text and rendering."""
