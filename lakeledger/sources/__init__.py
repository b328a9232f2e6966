"""Reading and writing: tables, directory trees, file content, change-event feeds."""
