"""Column expressions with the reference's semantics: dates, display formats, search predicates and text cleaning."""
