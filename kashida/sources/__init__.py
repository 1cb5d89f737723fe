"""Reading and writing tables and text files."""
