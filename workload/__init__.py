"""The driver's star schema as fact tables, and one query per operator over it."""
