"""Column functions: text, dates, patterns, paths, values, names, links, languages."""
