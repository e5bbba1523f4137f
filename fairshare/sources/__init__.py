"""Reading files into raw tables, tables into frames, frames into tables."""
