"""Column functions: everything here takes columns and gives a column, without Python workers."""
