"""Query plans; importing the package registers all of them in :mod:`.catalogue`."""

from . import catalogue, clusters, isolation, recordings, sorting, spikes  # noqa: F401
