"""Reading delimited files in mixed encodings, and taxonomies."""
