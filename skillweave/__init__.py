"""skillweave: job-advert skill extraction and competence mapping on Spark."""

__version__ = "0.1.0"
