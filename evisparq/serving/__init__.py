"""The engine behind HTTP: handlers that are plain functions, a server and a client page."""
