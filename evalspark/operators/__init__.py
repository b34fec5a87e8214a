"""DataFrame operators: metrics, resampling, sampling, vectors, classifiers, statistics."""
