"""DataFrame operators over points, cells and neighbour lists."""
