"""Column functions: text helpers and validators."""
