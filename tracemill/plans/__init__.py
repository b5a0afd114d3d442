"""The bronze, silver and gold models and the queries over them."""
