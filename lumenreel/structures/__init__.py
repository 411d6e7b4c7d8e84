"""File bytes to rows: every function maps the windows of a file to structs or arrays of structs."""
