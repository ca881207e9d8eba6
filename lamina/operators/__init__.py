"""DataFrame operators: evaluation, learning, monitoring, images."""
