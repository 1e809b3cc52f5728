"""Column expressions: field paths, selectors, collation keys, reducers' values and text analysis."""
