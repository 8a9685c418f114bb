"""Column functions: text, codes, logits and row checks."""
