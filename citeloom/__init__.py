"""citeloom: citation auditing and corpus operations as Spark plans."""
