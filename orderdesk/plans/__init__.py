"""The user-facing queries (reports, lists, documents) and the write jobs that commit several outputs together."""
