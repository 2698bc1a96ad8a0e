"""Sources, sinks and the log of resumable runs."""
