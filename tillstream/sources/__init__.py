from tillstream.sources import readers, sinks, testtables  # noqa: F401
