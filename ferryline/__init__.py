"""Data movement, change capture and parity analytics as Spark plans."""
