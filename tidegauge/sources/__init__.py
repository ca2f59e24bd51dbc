"""Reading and writing of landed pages, archives, tables and releases."""
