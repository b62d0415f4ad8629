"""Sessions over a saved table: the data verbs of an interactive tool, without its pages."""
