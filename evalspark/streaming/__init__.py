"""Running scores over a growing results folder."""
