"""Column functions: text, identity, links, rates, dates, sets and vectors."""
