"""Single passes and streaming runs."""
