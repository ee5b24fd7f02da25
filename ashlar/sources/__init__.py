"""Reading and writing: delimited text, fixed binary records, parser plug-ins, exports, named memory tables."""
