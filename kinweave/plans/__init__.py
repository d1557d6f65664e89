"""Plan building blocks: shared storage, ordered slices of hot keys, skew-safe lookups."""
