"""Relational operators over call sets (records), alleles and intervals."""
