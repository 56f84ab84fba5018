"""Named queries: operators composed over the test tables, with their SQL."""
