"""Part of lumenframe; see README.md for the layout."""
