"""DataFrame operators: kNN join and densities, selection, sampling, ensembles, metrics."""
