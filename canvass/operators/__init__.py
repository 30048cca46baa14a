"""Table operators: filters, codebook work, reshaping, tabulation, statistics."""
