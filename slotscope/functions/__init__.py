"""Row-level derivations: Column in, Column out."""
