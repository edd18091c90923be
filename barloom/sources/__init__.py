"""Tables that queries read."""
