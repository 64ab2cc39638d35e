"""Training-data operators: thirteen corpus operators and the pipeline that chains five of them."""
