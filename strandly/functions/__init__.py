"""Column expressions: alleles, INFO and FORMAT fields, strings, and aligned sequences."""
