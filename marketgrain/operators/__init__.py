"""Relational building blocks that Spark does not ship: checked joins, exact ranks, quality findings."""
