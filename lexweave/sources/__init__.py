"""Sources and sinks.

``readers`` turns files into tables (JSON arrays and lines, text, mail,
documents by extension, Atom feeds, dictionaries), ``writers`` the other way.
"""
