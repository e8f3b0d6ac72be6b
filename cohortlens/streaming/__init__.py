from cohortlens.streaming.requests import stream_latest, stream_requests  # noqa: F401
