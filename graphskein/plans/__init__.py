"""Plan building blocks: lineage cuts, fixpoint loops, heavy-key detection."""
