"""What the registered query and its SQL twin have to agree on."""

BITS, BANDS = 9, 256  # of knn_lsh: recall 0.92 on the given vectors at sf0.01, for scores of about 0.62 of all pairs
JOIN_COSINE = 0.4  # of vector_join: the given vectors reach about 0.55
