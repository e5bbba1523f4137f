"""The registered queries, the SQL they are checked against, and the frames both start from."""
