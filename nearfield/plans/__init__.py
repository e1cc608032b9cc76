"""Multi-step joins: count pyramid, pruning descent and the all-k-nearest-neighbour join."""
