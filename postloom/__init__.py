"""DataFrame operators for corpora of semi-structured postings and documents."""
