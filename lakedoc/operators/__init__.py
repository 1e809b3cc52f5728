"""DataFrame operators: collections, views, revisions, search."""
