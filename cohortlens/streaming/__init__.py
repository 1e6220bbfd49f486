"""No streaming operators are owed: every job of this library is a batch job over landed files."""
