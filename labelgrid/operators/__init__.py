"""Selection, reduction and aligned addition."""
