"""Reading reference tables and facts, writing results."""
