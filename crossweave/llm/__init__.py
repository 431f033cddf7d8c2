"""Training-data operators over document tables; nothing outside this folder imports it."""
