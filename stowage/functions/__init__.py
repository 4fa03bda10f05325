"""Column functions: classifiers, sizes, URLs, renderings."""
